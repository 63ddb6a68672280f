"""DuckDB SQL of the operators that take more than a line: hashes, spans, bands, folds and cosines."""

from __future__ import annotations

from weftcorpus.functions import rules
from weftcorpus.operators.dedup import MinHashDeduplicator, optimal_bands

_TOP = 1 << 64


def _mul(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT * {b}::UHUGEINT) % {_TOP}::UHUGEINT)"


def _add(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT + {b}::UHUGEINT) % {_TOP}::UHUGEINT)"


def _rotl(a: str, n: int) -> str:
    return f"({_mul(a, 1 << n)} + ({a})::UHUGEINT // {1 << (64 - n)}::UHUGEINT)"


def _fold(a: str, n: int) -> str:
    return f"xor({a}, ({a}) // {1 << n}::UHUGEINT)"


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def xxhash64_steps(source: str, key: str, seed: int, name: str) -> str:
    """CTEs up to `name`: source's rows with h, Spark's xxhash64(key, seed) for a long and an int, as a signed number."""
    steps = [
        f"SELECT *, xor({_P5 + 8 + 42}::UHUGEINT, {_mul(_rotl(_mul(f'(({key})::HUGEINT + {_TOP}::HUGEINT) % {_TOP}::HUGEINT', _P2), 31), _P1)}) AS x FROM {source}",
        f"SELECT * EXCLUDE x, {_add(_mul(_rotl('x', 27), _P1), _P4)} AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, {_mul(_fold('x', 33), _P2)} AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, {_mul(_fold('x', 29), _P3)} AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, {_fold('x', 32)} AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, xor({_add('x', _P5 + 4)}, {(seed * _P1) % _TOP}::UHUGEINT) AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, {_add(_mul(_rotl('x', 23), _P2), _P3)} AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, {_mul(_fold('x', 33), _P2)} AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, {_mul(_fold('x', 29), _P3)} AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, {_fold('x', 32)}::HUGEINT AS x FROM {{0}}",
        f"SELECT * EXCLUDE x, CASE WHEN x >= {_TOP // 2} THEN x - {_TOP}::HUGEINT ELSE x END AS h FROM {{0}}",
    ]
    names = [f"{name}_{i}" for i in range(len(steps) - 1)] + [name]
    return ",\n".join(f"{n} AS ({s.format(names[i - 1]) if i else s})" for i, (n, s) in enumerate(zip(names, steps)))


def styles(source: str, styles_: tuple[str, ...], seed: int = 42) -> str:
    """CTEs up to `styled`: source with rewrite_style."""
    whens = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(styles_))
    return f"""{xxhash64_steps(source, "row_id", seed, "hashed")},
styled AS (SELECT *, CASE WHEN response <> '' THEN CASE ((h % {len(styles_)}) + {len(styles_)}) % {len(styles_)} {whens} END END AS rewrite_style FROM hashed)"""


def slot_spans(source: str, text: str = "response", key: str = "row_id", slots: dict = rules.SLOTS) -> str:
    """CTEs up to `spans` (key, found: the list of st, en, kind, value that stay) and `annotated` (source with tagged, slots_<kind>)."""
    parts, order = [], 0
    for kind, patterns in slots.items():
        for p in patterns:
            q = p.replace("'", "''")
            parts.append(f"SELECT {key}, {order} AS ord, '{kind}' AS kind, regexp_split_to_array({text}, '{q}') AS gaps, regexp_extract_all({text}, '{q}') AS found FROM {source} WHERE regexp_matches({text}, '{q}')")
            order += 1
    kinds = ", ".join(f"coalesce(list_aggregate(list_sort(list_distinct(list_transform(list_filter(found, lambda s: s.kind = '{k}'), lambda s: s.value))), 'string_agg', '|'), '') AS {k}" for k in slots)
    return f"""matched AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT {key}, ord, kind, found[i] AS value, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS st FROM matched, unnest(generate_series(1, len(found))) AS u(i)),
listed AS (SELECT {key}, list({{'till': (st + length(value))::BIGINT, 'own': [{{'st': st::BIGINT, 'en': (st + length(value))::BIGINT, 'kind': kind, 'value': value}}]}} ORDER BY st, length(value) DESC, ord) AS every FROM placed GROUP BY 1),
spans AS (SELECT {key}, list_reduce(every, lambda a, x: CASE WHEN x.own[1].st >= a.till THEN {{'till': x.till, 'own': list_concat(a.own, x.own)}} ELSE a END).own AS found FROM listed),
pieces AS (SELECT s.{key}, string_agg(substr(q.{text}, (CASE WHEN i = 1 THEN 0 ELSE found[i - 1].en END + 1)::BIGINT, (found[i].st - CASE WHEN i = 1 THEN 0 ELSE found[i - 1].en END)::BIGINT) || '<slot type="' || found[i].kind || '">' || found[i].value || '</slot>', '' ORDER BY i) || substr(any_value(q.{text}), (any_value(found[len(found)].en) + 1)::BIGINT) AS tagged
  FROM spans s JOIN {source} q USING ({key}), unnest(generate_series(1, len(found))) AS u(i) GROUP BY 1),
annotated AS (SELECT q.*, coalesce(p.tagged, q.{text}) AS tagged, {kinds} FROM {source} q LEFT JOIN spans s USING ({key}) LEFT JOIN pieces p USING ({key}))"""


def kept_by_bands(source: str, key: str, stripped: str, d: MinHashDeduplicator) -> str:
    """CTEs up to `kept` (key): the rows of source that stay, near copies dropped in the order of key."""
    bands, rows = optimal_bands(d.threshold, d.num_perm)
    a, c = d.permutations()
    low = (1 << 32) - 1

    def permuted(x: int, y: int) -> str:
        """The upper 32 bits of h * x + y modulo 2^64, by halves, in 64-bit numbers."""
        x1, x0, y1, y0 = x >> 32, x & low, y >> 32, y & low
        return f"((((h0 * {x0}::UBIGINT) >> 32) + ((h0 * {x1}::UBIGINT) & {low}::UBIGINT) + ((h1 * {x0}::UBIGINT) & {low}::UBIGINT) + {y1}::UBIGINT + ((((h0 * {x0}::UBIGINT) & {low}::UBIGINT) + {y0}::UBIGINT) >> 32)) & {low}::UBIGINT)"

    least = ", ".join(f"min({permuted(x, y)}) AS s{k}" for k, (x, y) in enumerate(zip(a[: bands * rows].tolist(), c.tolist())))
    # rows of a band that agree in all its signatures share a bucket, whatever their hash
    banded = " UNION ALL ".join(f"SELECT {key}, {b} AS band, [{', '.join(f's{b * rows + i}' for i in range(rows))}] AS hash FROM least" for b in range(bands))
    n = d.ngram_size
    steps = []
    for i in range(n):
        mixed = _mul(f"xor(h, unicode(substr(gram, {i + 1}, 1))::UHUGEINT)", d.GRAM)
        steps.append(f"gram_{i} AS (SELECT gram, CASE WHEN length(gram) > {i} THEN {mixed} ELSE h END AS h FROM {'kinds' if i == 0 else f'gram_{i - 1}f'})")
        steps.append(f"gram_{i}f AS (SELECT gram, CASE WHEN length(gram) > {i} THEN {_fold('h', 29)} ELSE h END AS h FROM gram_{i})")
    joined = f"SELECT {key}, list(bucket) AS tests, list(bucket) AS adds, row_number() OVER (ORDER BY {key}) AS place FROM members GROUP BY {key}"
    if d.verify:
        # a row is tested against the kept ones among those of its buckets that are similar
        joined = f"""SELECT m.{key}, coalesce(any_value(near), []) AS tests, [m.{key}] AS adds, row_number() OVER (ORDER BY m.{key}) AS place FROM (SELECT DISTINCT {key} FROM members) m LEFT JOIN (
  SELECT row, list(other) AS near FROM (SELECT p.row, p.other, count(*) AS common FROM (SELECT DISTINCT x.{key} AS row, y.{key} AS other FROM members x JOIN members y ON x.bucket = y.bucket AND y.{key} < x.{key}) p
    JOIN grams a ON a.{key} = p.row JOIN grams b ON b.{key} = p.other AND b.gram = a.gram GROUP BY 1, 2)
  JOIN (SELECT {key} AS row, count(*) AS na FROM grams GROUP BY 1) USING (row) JOIN (SELECT {key} AS other, count(*) AS nb FROM grams GROUP BY 1) USING (other) WHERE common >= {d.threshold} * (na + nb - common) GROUP BY 1) n ON n.row = m.{key} GROUP BY m.{key}"""
    return f"""texts AS (SELECT {key}, {stripped} AS t FROM {source} WHERE {stripped} <> ''),
grams AS (SELECT DISTINCT {key}, CASE WHEN length(t) < {n} THEN t ELSE substr(t, CAST(i AS INT), {n}) END AS gram FROM texts, unnest(generate_series(1, greatest(length(t) - {n - 1}, 1))) AS u(i)),
kinds AS (SELECT DISTINCT gram, 0::UHUGEINT AS h FROM grams),
{", ".join(steps)},
hashed AS (SELECT gram, (h // {1 << 32}::UHUGEINT)::UBIGINT AS h1, (h % {1 << 32}::UHUGEINT)::UBIGINT AS h0 FROM gram_{n - 1}f),
least AS (SELECT {key}, {least} FROM grams JOIN hashed USING (gram) GROUP BY 1),
banded AS ({banded}),
shared AS (SELECT band, hash, row_number() OVER (ORDER BY band, hash) AS bucket FROM banded GROUP BY band, hash HAVING count(*) > 1),
members AS (SELECT {key}, bucket FROM banded JOIN shared USING (band, hash)),
joined AS ({joined}),
greedy AS (SELECT 0::BIGINT AS place, NULL::BIGINT AS k, []::BIGINT[] AS seen UNION ALL
  SELECT j.place, CASE WHEN list_has_any(g.seen, j.tests) THEN NULL ELSE j.{key} END, CASE WHEN list_has_any(g.seen, j.tests) THEN g.seen ELSE list_concat(g.seen, j.adds) END FROM greedy g JOIN joined j ON j.place = g.place + 1),
kept AS (SELECT {key} FROM texts WHERE {key} NOT IN (SELECT {key} FROM joined) UNION ALL SELECT k FROM greedy WHERE k IS NOT NULL)"""


def template_metrics(source: str, by: str = "model", key: str = "row_id", text: str = "response", features: int = 5000, threshold: float = 0.85) -> str:
    """CTEs up to `template`: all template metrics of each group of source (key, text, by)."""
    patterns = " OR ".join(f"regexp_matches({text}, '{p}')" for p in rules.TEMPLATE_SENTENCES)
    at = lambda n, c: f"coalesce(max({c}) FILTER (n = {n}), 0)"
    return f"""said AS (SELECT {by}, {key}, {text} FROM {source} WHERE {text} <> ''),
tokens AS (SELECT {by}, replace(replace({text}, ' ', ''), chr(10), '') AS t FROM said),
token_grams AS (SELECT {by}, k AS n, substr(t, CAST(i AS INT), k) AS gram, count(*) AS c FROM tokens, (SELECT unnest([2, 3, 4]) AS k), unnest(generate_series(1, length(t) - k + 1)) AS u(i) GROUP BY ALL),
gram_counts AS (SELECT {by}, n, sum(c) AS grams, count(*) AS kinds, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS again FROM token_grams GROUP BY ALL),
wide AS (SELECT {by}, {", ".join(f"{at(n, 'again')} / {at(n, 'grams')} AS cross_ngram_rep_{n}" for n in (2, 3, 4))}, {", ".join(f"{at(n, 'kinds')} / {at(n, 'grams')} AS distinct_{n}" for n in (2, 3))} FROM gram_counts GROUP BY 1),
patterned AS (SELECT {by}, count(*) AS total_responses, avg(({patterns})::INT) AS sentence_pattern_rate FROM said GROUP BY 1),
alike AS (SELECT {by}, {text}, min({key}) AS class, count(*) AS copies, regexp_replace(rtrim(regexp_replace(lower({text}), '(.)', '\\1 ', 'g')), ' +', ' ', 'g') AS spaced FROM said GROUP BY ALL),
raw_terms AS (SELECT {by}, class, copies, substr(spaced, CAST(i AS INT), k) AS term, count(*) AS tf FROM alike, (SELECT unnest([2, 3]) AS k), unnest(generate_series(1, length(spaced) - k + 1)) AS u(i) GROUP BY ALL),
term_totals AS (SELECT {by}, term, sum(tf * copies) AS total, sum(copies) AS df FROM raw_terms GROUP BY ALL),
terms AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY total DESC, term) AS place FROM term_totals QUALIFY place <= {features}),
weighed AS (SELECT r.{by}, class, copies, place, tf * (ln((total_responses + 1) / (df + 1)) + 1) AS x FROM raw_terms r JOIN terms t ON r.{by} = t.{by} AND r.term = t.term JOIN patterned p ON p.{by} = r.{by}),
scaled AS (SELECT {by}, class, copies, place, x / sqrt(sum(x * x) OVER (PARTITION BY {by}, class)) AS w FROM weighed),
width AS (SELECT {by}, max(place) AS width FROM terms GROUP BY 1),
dense AS (SELECT s.{by}, class, copies, list_transform(generate_series(1, any_value(width)), lambda i: coalesce(map_from_entries(list({{'k': place, 'v': w}}))[i], 0.0::DOUBLE)) AS v FROM scaled s JOIN width USING ({by}) GROUP BY ALL),
near AS (SELECT a.{by}, sum(a.copies * b.copies) AS k FROM dense a JOIN dense b ON a.{by} = b.{by} AND a.class < b.class AND list_dot_product(a.v, b.v) >= {threshold} GROUP BY 1),
same AS (SELECT {by}, sum(copies * (copies - 1) / 2) AS k FROM alike GROUP BY 1),
metrics AS (SELECT p.{by}, total_responses, cross_ngram_rep_2, cross_ngram_rep_3, cross_ngram_rep_4, distinct_2, distinct_3, sentence_pattern_rate, (coalesce(near.k, 0) + same.k) / greatest(total_responses * (total_responses - 1) / 2, 1) AS semantic_cluster_rate
  FROM patterned p JOIN wide USING ({by}) JOIN same USING ({by}) LEFT JOIN near USING ({by})),
template AS (SELECT *, (cross_ngram_rep_3 + sentence_pattern_rate + semantic_cluster_rate + (1 - distinct_2)) / 4 AS overall_template_rate FROM metrics)"""


def early_stop(source: str, run: str = "run", patience: int = 5) -> str:
    """The stop of each run of source (run, step, metric) whose metrics are whole numbers: then a value is better if and only if it is a new minimum."""
    return f"""WITH {source}, b AS (SELECT *, min(metric) OVER w AS low, row_number() OVER w AS place FROM r WINDOW w AS (PARTITION BY {run} ORDER BY step ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, max(CASE WHEN place = 1 OR low < before THEN place END) OVER (PARTITION BY {run} ORDER BY step ROWS UNBOUNDED PRECEDING) AS last FROM (SELECT *, lag(low) OVER (PARTITION BY {run} ORDER BY step) AS before FROM b)),
s AS (SELECT {run}, min(step) FILTER (place - last >= {patience}) AS stop_step, min(low) AS least FROM i GROUP BY 1)
SELECT s.{run}, coalesce(i.low, s.least) AS best, stop_step IS NOT NULL AS stopped, stop_step FROM s LEFT JOIN i ON i.{run} = s.{run} AND i.step = s.stop_step"""


def paired_effect(rows: str, by: str, z: float = 1.959963984540054) -> str:
    """Effect sizes of the differences d in rows, for groups of some thousand rows: p by Simpson's rule over the density of t, the
    quantile by its expansion in 1 / dof around the normal one (z, of 0.975)."""
    terms = ("(z3 + z) / 4", "(5 * z5 + 16 * z3 + 3 * z) / 96", "(3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / 384")
    values = {"z": z, "z3": z**3, "z5": z**5, "z7": z**7}
    grow = " + ".join(f"{eval(t, {}, values)!r}::DOUBLE / pow(v, {i + 1})" for i, t in enumerate(terms))  # noqa: S307
    return f"""WITH x AS ({rows}), s AS (SELECT {by}, count(*) AS n, avg(d) AS m, stddev_samp(d) AS s, count(*) - 1.0::DOUBLE AS v FROM x GROUP BY 1), t AS (SELECT *, abs(m / (s / sqrt(n))) AS t FROM s),
q AS (SELECT {by}, sum((CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(t * i / 20000, 2) / v, -(v + 1) / 2)) * t / 20000 / 3 AS half FROM t, range(20001) AS r(i) GROUP BY {by}, t)
SELECT {by}, n, round(1 - 2 * half, 6) AS p_value, round(m / s, 6) AS effect_size, round(m - s / sqrt(n) * ({z!r}::DOUBLE + {grow}), 6) AS ci_low, round(m + s / sqrt(n) * ({z!r}::DOUBLE + {grow}), 6) AS ci_high FROM t JOIN q USING ({by})"""


def anova_effect(rows: str) -> str:
    """p and eta squared of rows (g, x) with an odd number of groups, for which the tail of F is a finite sum."""
    return f"""WITH x AS ({rows}), s AS (SELECT g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY 1), a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * v) AS within FROM s),
b AS (SELECT k - 1 AS d1, n - k AS d2, within, (SELECT sum(n * pow(m - a.mean, 2)) FROM s) AS between FROM a), f AS (SELECT *, d2 / (d2 + d1 * ((between / d1) / (within / d2))) AS y FROM b)
SELECT round(sum(exp(lgamma(d2 / 2 + i) - lgamma(d2 / 2) - lgamma(i + 1.0)) * pow(y, d2 / 2) * pow(1 - y, i)), 6) AS p_value, round(any_value(between / (between + within)), 9) AS eta_squared FROM f, range((d1 / 2)::BIGINT) AS r(i)"""


def segments(source: str, words: dict[str, int], unknown: int = 20_000, key: str = "row_id", text: str = "response") -> str:
    """CTEs up to `segments` (key, words joined by |, n_words): the cheapest path through the lattice of words, whose last word is the longest of
    equal ones. The paths to the last few places of each text go along in a recursion over places."""
    most = max(map(len, words))
    listed = ", ".join(f"('{w}', {c})" for w, c in words.items())
    return f"""dictionary AS (SELECT map_from_entries(list((w, c))) AS costs FROM (VALUES {listed}) AS t(w, c)),
plain AS (SELECT {key}, replace(replace({text}, ' ', ''), chr(10), '') AS t FROM {source}),
walk AS (SELECT {key}, t, 0 AS i, [{{'cost': 0::BIGINT, 'path': '', 'n': 0::BIGINT}}] AS ends FROM plain UNION ALL
  SELECT {key}, t, i + 1, list_concat(ends[greatest(len(ends) - {most - 2}, 1):], list_transform([list_min(list_filter(list_transform(range(1, least(i + 1, {most}) + 1), lambda k:
    {{'cost': ends[len(ends) - k + 1].cost + CASE WHEN k = 1 THEN least(coalesce(costs[substr(t, i + 2 - k, k)], {unknown}), {unknown}) ELSE costs[substr(t, i + 2 - k, k)] END, 'neg': -k,
      'path': ends[len(ends) - k + 1].path || CASE WHEN ends[len(ends) - k + 1].path = '' THEN '' ELSE '|' END || substr(t, i + 2 - k, k), 'n': ends[len(ends) - k + 1].n + 1}}), lambda x: x.cost IS NOT NULL))], lambda m: {{'cost': m.cost, 'path': m.path, 'n': m.n}}))
  FROM walk, dictionary WHERE i < length(t)),
segments AS (SELECT {key}, ends[len(ends)].path AS words, ends[len(ends)].n AS n_words FROM walk WHERE i = length(t))"""


def cluster_rate(source: str, key: str = "row_id", text: str = "response", features: int = 5000, threshold: float = 0.85) -> str:
    """The share of pairs of all responses of source with a cosine of threshold or more. Only pairs that share one of both texts' rarest terms, up to
    where the rest is shorter than the threshold, can have it; their vectors are multiplied term by term."""
    return f"""said AS (SELECT {key}, {text} FROM {source} WHERE {text} <> ''),
alike AS (SELECT {text}, min({key}) AS class, count(*) AS copies, regexp_replace(rtrim(regexp_replace(lower({text}), '(.)', '\\1 ', 'g')), ' +', ' ', 'g') AS spaced FROM said GROUP BY 1),
raw_terms AS (SELECT class, copies, substr(spaced, CAST(i AS INT), k) AS term, count(*) AS tf FROM alike, (SELECT unnest([2, 3]) AS k), unnest(generate_series(1, length(spaced) - k + 1)) AS u(i) GROUP BY ALL),
totals AS (SELECT term, sum(tf * copies) AS total, sum(copies) AS df FROM raw_terms GROUP BY 1),
terms AS (SELECT *, (row_number() OVER (ORDER BY df, term))::INT AS place FROM (SELECT * FROM totals ORDER BY total DESC, term LIMIT {features})),
weighed AS (SELECT class::INT AS class, copies, place, tf * (ln(((SELECT count(*) FROM said) + 1) / (df + 1)) + 1) AS x FROM raw_terms JOIN terms USING (term)),
scaled AS MATERIALIZED (SELECT class, copies, place, x / sqrt(sum(x * x) OVER (PARTITION BY class)) AS w FROM weighed),
tails AS (SELECT class, place, sum(w * w) OVER (PARTITION BY class ORDER BY place DESC) AS tail FROM scaled),
rare AS MATERIALIZED (SELECT class, place FROM tails WHERE tail >= {threshold * threshold} - 1e-9),
pairs AS MATERIALIZED (SELECT DISTINCT a.class AS a, b.class AS b FROM rare a JOIN rare b ON a.place = b.place AND a.class < b.class),
near AS (SELECT p.a, p.b, any_value(x.copies * y.copies) AS k FROM pairs p JOIN scaled x ON x.class = p.a JOIN scaled y ON y.class = p.b AND y.place = x.place GROUP BY 1, 2 HAVING sum(x.w * y.w) >= {threshold}),
rate AS (SELECT ((SELECT coalesce(sum(k), 0) FROM near) + (SELECT sum(copies * (copies - 1) / 2) FROM alike)) / greatest((SELECT count(*) * (count(*) - 1) / 2 FROM said), 1) AS semantic_cluster_rate)"""
