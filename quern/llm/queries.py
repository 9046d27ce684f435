"""Registered queries of this package, one per operator, and their SQL where it exists."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from quern.llm.alignment import align_tokens
from quern.llm.collocations import collocations
from quern.llm.decontaminate import contamination
from quern.llm.exact_dedup import exact_groups
from quern.llm.line_dedup import dedup_lines
from quern.llm.outliers import (
    CELLS, COARSE, COVERED, LEAST_ROWS, STATISTICS, STAY, STEPS, UNIT, Estimates, chi_square_quantile, quality_verdicts,
)
from quern.llm.packing import pack_documents
from quern.llm.quality import quality_scores
from quern.llm.secret_scan import RULES, Rule, scan_secrets, span_digest
from quern.llm.simhash import near_duplicates
from quern.llm.suffix_dedup import remove_repeats
from quern.llm.token_counts import count_tokens
from quern.llm.toxicity import toxicity_scores
from quern.session import spread

TOKENIZERS = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is; any other path may be given to the operators."""
    return importlib.import_module(TOKENIZERS).path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for operators that work row by row: a small file is dealt over all cores."""
    return spread(_table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"), least_words=50).drop("text")


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^ \t\r\f\x0B]+')) AS n FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
e AS (
  SELECT doc_id, i, line, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 4 = 0 AS ends
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (
  SELECT doc_id, i, line, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM e),
c AS (SELECT doc_id, no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS t FROM n GROUP BY doc_id, no),
r AS (SELECT *, n_lines >= 2 AND row_number() OVER (PARTITION BY t ORDER BY doc_id, no) > 1 AS gone FROM c),
s AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS c, lead(i) OVER w AS next FROM l WHERE n > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT a.doc_id, a.k AS a, b.k AS b, a.i AS start, b.next AS stop FROM s a JOIN s b
  ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 50 AND b.c - a.c + a.n > 50
  WHERE b.c - b.n - a.c + a.n <= 50 OR b.c - a.c <= 50),
t AS (SELECT p.doc_id, start, stop, string_agg(line, chr(10) ORDER BY k) AS t
  FROM p JOIN s ON s.doc_id = p.doc_id AND k BETWEEN a AND b GROUP BY p.doc_id, start, stop),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, start) AS r FROM t) WHERE r > 1),
m AS (SELECT n.doc_id, n.i, n.line, bool_or(r.gone OR g.doc_id IS NOT NULL) AS gone
  FROM n JOIN r USING (doc_id, no) LEFT JOIN g ON g.doc_id = n.doc_id AND n.i >= start AND (stop IS NULL OR n.i < stop) GROUP BY ALL),
o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
x AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (opens) AS n_removed_runs, count(*) FILTER (gone) AS n_removed_lines,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM o GROUP BY doc_id)
SELECT x.*, n_chunks, n_removed_chunks FROM x
  JOIN (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks FROM r GROUP BY doc_id) USING (doc_id)
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


OP3_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
part AS (SELECT doc_id, n, k, substr(h, 2 * k + 1, 710) AS s FROM (SELECT doc_id, h, n, unnest(range(0, n, 256)) AS k FROM b)),
pos AS MATERIALIZED (SELECT doc_id, k + j AS i, substr(s, 2 * j + 1, 2) AS byte,
  CASE WHEN k + j + 100 <= n THEN substr(s, 2 * j + 1, 200) END AS g
  FROM (SELECT *, unnest(range(least(256, n - k))) AS j FROM part)),
firsts AS (SELECT g, min((doc_id, i)) AS first FROM pos WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1),
dup AS (SELECT doc_id, i, byte, CASE WHEN first IS NOT NULL AND (doc_id, i) <> first THEN i END AS d
  FROM pos LEFT JOIN firsts USING (g)),
cov AS (SELECT doc_id, i, byte, coalesce(max(d) OVER (PARTITION BY doc_id ORDER BY i) >= i - 99, false) AS gone FROM dup),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM cov),
agg AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
  string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM run GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN agg USING (doc_id)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return count_tokens(_documents(spark, sf_dir), path, limit=512)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, j - 1 AS k, array_to_string(w[j:j + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM bl)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, j, k FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id),
runs AS (SELECT doc_id, item_id::VARCHAR AS i, min(j) - 1 AS a, min(k) AS b, count(*) + n - 1 AS m FROM (
    SELECT *, j - row_number() OVER (PARTITION BY doc_id, item_id, n, j - k ORDER BY j) AS run FROM hit)
  GROUP BY doc_id, item_id, n, j - k, run),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, a, i, b) = 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(m, 0)::BIGINT AS longest_words,
  a::BIGINT AS longest_at, i AS longest_item, b::BIGINT AS longest_item_at
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)
"""

def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(_documents(spark, sf_dir)))


def _rule_sql(number: int, rule: Rule) -> str:
    """Spans of one rule: matches and the gaps before them give the places."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {number} AS o, {rule.base} AS base, start, start + length(m) AS stop FROM (
  SELECT doc_id, m, g, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(m) AS start FROM (
    SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS g,
      unnest(string_split_regex(t, '{pattern}')) AS gap, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i
    FROM d) WHERE m IS NOT NULL) WHERE length(g) >= {rule.least}"""


_SPAN = "kind || ':' || start || ':' || stop, ',' ORDER BY start, o"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(k, rule) for k, rule in enumerate(RULES))}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg({_SPAN}) FILTER (base) AS b, string_agg({_SPAN}) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


OP11_SQL = r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (
  SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) t(m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
cut AS (SELECT lang, m, phrase, a, k, array_to_string(w[:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN n USING (lang) JOIN f x ON x.lang = cut.lang AND x.phrase = left_part JOIN f y ON y.lang = cut.lang AND y.phrase = right_part
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS a FROM (
  SELECT lang, w, m, a, i, unnest(range(i + 1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m)) AS i FROM c WHERE m > 2)) WHERE j - i + 1 < m GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inner_parts p ON p.lang = s.lang AND p.phrase = s.phrase WHERE p.a IS NULL OR 100 * p.a < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept QUALIFY rank <= 2000
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_documents(spark, sf_dir)).drop("distance")


def _op13_sql() -> str:
    """Statistics, groups and start, then the concentration steps one after another."""
    floors = list(STATISTICS.values())
    e, p = Estimates(floors), len(floors)

    def at_share(q: float, cell: str) -> str:
        return f"min(CASE WHEN run >= {q} * total THEN {cell} END)"

    def estimates(name: str, rows: str) -> str:
        steps = f"SELECT _group, {', '.join(e.sums)} FROM {rows} GROUP BY _group"
        for level in e.whitening():
            steps = f"SELECT *, {', '.join(level)} FROM ({steps})"
        return f"{name} AS MATERIALIZED (SELECT {', '.join(e.columns)} FROM ({steps}))"

    def limits(name: str, of: str, share: float) -> str:
        counted = f"SELECT _group, {e.cell} AS c, count(*) AS n FROM v JOIN {of} USING (_group) GROUP BY ALL"
        running = f"SELECT *, sum(n) OVER (PARTITION BY _group ORDER BY c) AS run, sum(n) OVER (PARTITION BY _group) AS total FROM ({counted})"
        return f"{name} AS MATERIALIZED (SELECT _group, {at_share(share, 'c')} AS _limit FROM ({running}) GROUP BY _group)"

    melted = " UNION ALL ".join(f"SELECT _group, {i} AS s, floor(_x{i} / {COARSE})::INT AS c, {f * UNIT}**2 AS floor FROM v" for i, f in enumerate(floors))
    of = [f"max(CASE WHEN s = {i} THEN m END) AS _m{i}, max(CASE WHEN s = {i} THEN w END) AS _w{i}_{i}" for i in range(p)]
    of += [f"0::DOUBLE AS _w{i}_{j}" for i in range(p) for j in range(i)]
    parts = [
        rf"""d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
sizes AS (SELECT lang, source, count(*) AS size FROM s WHERE NOT base_failed GROUP BY ALL),
groups AS (SELECT lang, source, g AS _group FROM (
  SELECT *, concat(coalesce(lang, '?'), ' ', CASE WHEN size >= {LEAST_ROWS} THEN coalesce(source, '?') ELSE '*' END) AS g FROM sizes)
  QUALIFY sum(size) OVER (PARTITION BY g) >= {LEAST_ROWS}),
v AS MATERIALIZED (SELECT _group, doc_id, floor(ln(n_words + 1) * {UNIT} + 0.5)::BIGINT AS _x0,
  floor(ln((word_chars::DOUBLE + 1) / (n_words + 1)) * {UNIT} + 0.5)::BIGINT AS _x1,
  floor(sqrt(n_symbols::DOUBLE / greatest(word_chars, 1)) * {UNIT} + 0.5)::BIGINT AS _x2,
  floor(sqrt(n_capitals::DOUBLE / greatest(word_chars, 1)) * {UNIT} + 0.5)::BIGINT AS _x3,
  floor(sqrt(n_dup_lines::DOUBLE / greatest(n_lines, 1)) * {UNIT} + 0.5)::BIGINT AS _x4,
  floor(sqrt(n_repeat_words::DOUBLE / greatest(n_words, 1)) * {UNIT} + 0.5)::BIGINT AS _x5
  FROM s JOIN groups ON s.lang IS NOT DISTINCT FROM groups.lang AND s.source IS NOT DISTINCT FROM groups.source WHERE NOT base_failed),
melted AS (SELECT _group, s, c, any_value(floor) AS floor, count(*) AS n FROM ({melted}) GROUP BY _group, s, c),
quartiles AS (SELECT _group, s, any_value(floor) AS floor, {at_share(0.25, "c")} AS a, {at_share(0.5, "c")} AS b, {at_share(0.75, "c")} AS c FROM (
  SELECT *, sum(n) OVER (PARTITION BY _group, s ORDER BY c) AS run, sum(n) OVER (PARTITION BY _group, s) AS total FROM melted) GROUP BY _group, s),
e0 AS MATERIALIZED (SELECT _group, {", ".join(of)} FROM (SELECT _group, s, (b + 0.5::DOUBLE) * {COARSE} AS m,
  1 / sqrt(((c - a) * ({COARSE}::DOUBLE / 1.349::DOUBLE))**2 + floor) AS w FROM quartiles) GROUP BY _group)"""
    ]
    for k in range(STEPS):
        near = f"(SELECT v.* FROM v JOIN e{k} USING (_group) JOIN l{k} USING (_group) WHERE {e.cell} <= _limit)"
        parts += [limits(f"l{k}", f"e{k}", COVERED), estimates(f"e{k + 1}", near)]
    parts.append(limits("middle", f"e{STEPS}", 0.5))
    scale = f"least(1, {chi_square_quantile(0.5, p)}::DOUBLE / ((_limit + 0.5::DOUBLE) / {CELLS})**2)"
    parts.append(f"far AS (SELECT doc_id FROM v JOIN e{STEPS} USING (_group) JOIN middle USING (_group) WHERE ({e.distance}) * {scale} > {chi_square_quantile(STAY, p)})")
    return f"""WITH {(chr(44) + chr(10)).join(parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM far) AS kept FROM s"""


OP13_SQL = _op13_sql()

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
    "op11_collocations": op11_collocations,
    "op12_token_alignment": op12_token_alignment,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op3_suffix_array_dedup": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_secret_scan": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op13_quality_rules": OP13_SQL,
}
