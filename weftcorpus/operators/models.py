"""Models as columns: loaded once for each Python worker, asked in batches.

A judge, a rewriter or a reward model is two functions: load() makes the model,
answer(model, ...) takes lists of texts, one for each column, and gives a list of
answers. model_column() turns them into a column function that
FactualityEvaluator(judge=...), TaskCompletionEvaluator(judge=...),
TemplateRewriter(generate=...) and scored_rewards(reward=...) take. A batch that
fails is asked again one by one, so that one bad text costs one answer, which is
null then.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftcorpus.functions import rules
from weftcorpus.functions import text as T

def loaded(name: str, load: Callable[[], object]):
    """The model of this name in this Python process, loaded by whichever task asks first; a worker lives through many tasks,
    but the modules that come with a function may not."""
    models = sys.modules.setdefault("_weft_models", type(sys)("_weft_models")).__dict__
    if name not in models:
        models[name] = load()
    return models[name]


def answered(model, answer: Callable[..., Sequence], columns: Sequence[Sequence], batch_size: int) -> list:
    """The answers for rows given by columns, batch by batch; None for rows that fail by themselves."""
    out, n = [], len(columns[0])
    for at in range(0, n, batch_size):
        part = [list(c[at : at + batch_size]) for c in columns]
        try:
            got = list(answer(model, *part))
            if len(got) != len(part[0]):
                raise ValueError(f"{len(got)} answers for {len(part[0])} rows")
        except Exception:
            got = []
            for row in zip(*part):
                try:
                    (one,) = answer(model, *([x] for x in row))
                except Exception:
                    one = None
                got.append(one)
        out += got
    return out


def model_column(name: str, load: Callable[[], object], answer: Callable[..., Sequence], returns: str = "string", batch_size: int = 64) -> Callable[..., Column]:
    """A function of text columns whose rows a model answers. name: of the model and its version, by which workers keep it."""

    def asked(batches):
        model = None
        for columns in batches:
            if model is None:
                model = loaded(name, load)
            columns = columns if isinstance(columns, tuple) else (columns,)
            yield pd.Series(answered(model, answer, [c.tolist() for c in columns], batch_size), dtype="float64" if returns == "double" else object)

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return asked(batches)

    def several(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        return asked(batches)

    return lambda *columns: pandas_udf(several if len(columns) > 1 else one, returns)(*[T.text(c) for c in columns])


def parse_status(answer: Column, pattern: str = rules.JUDGE_SCORE) -> Column:
    """How a judge's answer could be read: no_answer (null: the model failed), empty, unparsed (no score in it: the default counts) or parsed."""
    return F.when(answer.isNull(), "no_answer").when(T.strip(answer) == "", "empty").when(answer.rlike(T.rx(pattern)), "parsed").otherwise("unparsed")
