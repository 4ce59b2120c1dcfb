"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapdelta.llm import align, bpe, classifier, exact, jaccard, lines, lm, mixing, near, quality, repeats, search, sharding
from snapdelta.llm.common import benchmark, documents, labels, tokenizer

QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

_NEXT = ", ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, quality.WINDOW)]])

QUALITY_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_SPLIT} AS words FROM documents),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
u AS (SELECT doc_id, unnest(words) AS w, unnest(generate_series(1, len(words))) AS i FROM w),
starts AS (
  SELECT doc_id, i, win FROM (
    SELECT doc_id, i, concat_ws(' ', {_NEXT}) AS win, lead(w, {quality.WINDOW - 1}) OVER o AS final FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE final IS NOT NULL),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM starts) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY doc_id),
vocabulary AS (
  SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, (i - 1) // {quality.BLOCK} AS block, count(DISTINCT w) AS n FROM u GROUP BY ALL) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(words) - coalesce(list_sum(list_transform(list_distinct(ls),
      lambda l: len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')))), 0) AS n_dup_words,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    coalesce(vocabulary.n, 0) AS n_distinct,
    len(list_filter(words, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN vocabulary USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_stop_words,
  NOT base_failed AND coalesce(n_words >= 20
    AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 14.0
    AND n_symbols::DOUBLE / n_words <= 0.1
    AND n_stop_words::DOUBLE / n_words >= 0.03
    AND n_distinct::DOUBLE / n_words >= 0.28
    AND n_dup_words::DOUBLE / n_words <= 0.3
    AND n_repeat_words::DOUBLE / n_words <= 0.3, false) AS kept
FROM b
"""


@_query("op3_quality_rules", QUALITY_SQL)
def op3_quality_rules(spark, sf_dir):
    return quality.measured(documents(spark, sf_dir))


_TABLE = ", ".join(f"({i}, '{name}')" for i, name in enumerate(sharding.lookup_table()))


@_query(
    "op6_sharding",
    f"""
WITH places(slot, shard) AS (VALUES {_TABLE}),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, d.slot::BIGINT AS slot, shard FROM d JOIN places ON d.slot = places.slot
""",
)
def op6_sharding(spark, sf_dir):
    return sharding.placed(documents(spark, sf_dir))


@_query(
    "op10_exact_dedup",
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, keep_id, group_size, d.doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
""",
)
def op10_exact_dedup(spark, sf_dir):
    return exact.labelled(documents(spark, sf_dir))


@_query("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    path, pattern = tokenizer()
    coded = bpe.decoded(bpe.encoded(documents(spark, sf_dir), path, pattern), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def _sql_case(column: str, values: dict, default) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default!r} END"


def mixing_sql(mix: mixing.Mix, table: str = "documents") -> str:
    """SQL of ``mixing.drawn``: one water-filling step per level, then the seeded prefix per leaf."""
    domain_of = {source: name for name, sources in mix.domains.items() for source in sources}
    steps, parent = [], []
    for depth, level in enumerate(mixing.LEVELS):
        path = [*mixing.LEVELS[: depth + 1]]
        above = "given0" if not depth else f"given{depth}"
        link = "CROSS JOIN given0" if not depth else f"JOIN {above} USING ({', '.join(parent)})"
        group = f"PARTITION BY {', '.join(parent)}" if parent else ""
        weight = _sql_case(level, mix.weights.get(level, {}), mix.default_weight)
        steps.append(f"""
n{depth} AS (SELECT *, capacity / w AS ratio FROM (
  SELECT {', '.join(path)}, capacity, given, CAST({weight} AS DOUBLE) AS w FROM (
    SELECT {', '.join(path)}, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY {', '.join(path)}) {link}) WHERE w > 0),
f{depth} AS (SELECT *, coalesce(sum(capacity) OVER ({group} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + ratio * sum(w) OVER ({group} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= given AS fu FROM n{depth}),
given{depth + 1} AS (SELECT {', '.join(path)}, CASE WHEN fu THEN CAST(capacity AS DOUBLE) ELSE
    (given - coalesce(sum(CASE WHEN fu THEN capacity END) OVER ({group}), 0)) * w / sum(CASE WHEN NOT fu THEN w END) OVER ({group}) END AS given FROM f{depth})""")
        parent = path
    asked = f"CAST({mix.budget_tokens} AS DOUBLE)" if mix.budget_tokens is not None else f"sum(supply) * CAST({mix.budget_share} AS DOUBLE)"
    return f"""
WITH d AS (SELECT doc_id, {_sql_case("coalesce(source, '')", domain_of, "other")} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len({_SPLIT})::BIGINT AS n_tokens FROM {table}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::BIGINT * {mix.max_epochs} AS capacity FROM d GROUP BY ALL),
given0 AS (SELECT least({asked}, CAST(sum(capacity) AS DOUBLE)) AS given FROM leaves),{",".join(steps)},
b AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs FROM (
  SELECT domain, lang, source, supply, CAST(floor(given + 1e-6) AS BIGINT) AS budget FROM given3 JOIN leaves USING (domain, lang, source))),
p AS (SELECT d.*, budget, epochs, budget - epochs * supply AS rest,
  md5(concat_ws(':', '{mix.seed}', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS place
  FROM d JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget,
  (epochs + CASE WHEN coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest THEN 1 ELSE 0 END)::BIGINT AS times
FROM p
"""


MIX = mixing.Mix()


@_query("op4_source_mixing", mixing_sql(MIX))
def op4_source_mixing(spark, sf_dir):
    return mixing.drawn(documents(spark, sf_dir), MIX)


@_query("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark, sf_dir):
    return near.clustered(documents(spark, sf_dir))


@_query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    found = repeats.deduplicated(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query("op7_lm_scoring")
def op7_lm_scoring(spark, sf_dir):
    return lm.scored(documents(spark, sf_dir))


@_query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return classifier.scored(docs, classifier.fit(docs, labels(spark, sf_dir)))


_CONTENTS = [", ".join(["content", *[f"c{k}" for k in range(1, width)]]) for width in range(1, lines.RUN + 1)]
_LATER = " UNION ALL ".join(
    f"""SELECT doc_id, line, {width} AS width FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY {_CONTENTS[width - 1]} ORDER BY doc_id, line) AS copy
    FROM w WHERE n >= {width}{"" if width == lines.RUN else f" AND words{width} >= {lines.LONG_WORDS}"}) WHERE copy > 1"""
    for width in range(1, lines.RUN + 1)
)
_WORDS = r"len(list_filter(string_split_regex(content, '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
LINES_SQL = f"""
WITH l AS (
  SELECT *, {_WORDS} AS words FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
      unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS line FROM documents)),
w AS (
  SELECT doc_id, line, content, count(*) OVER r AS n, {", ".join(f"lead(content, {k}) OVER o AS c{k}" for k in range(1, lines.RUN))},
    {", ".join(" + ".join(["words", *[f"lead(words, {k}) OVER o" for k in range(1, width)]]) + f" AS words{width}" for width in range(1, lines.RUN))}
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line), r AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND {lines.RUN - 1} FOLLOWING)),
later AS ({_LATER}),
gone AS (SELECT DISTINCT doc_id, line + k AS line FROM later, generate_series(0, {lines.RUN - 1}) AS t(k) WHERE k < width),
runs AS (SELECT doc_id, count(*) AS n_runs FROM (
  SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS prev FROM gone) WHERE prev IS NULL OR line > prev + 1 GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(content, chr(10) ORDER BY line) AS text FROM l ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, (n_lines - coalesce(n_kept, 0))::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM totals LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


@_query("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark, sf_dir):
    found = lines.deduplicated(documents(spark, sf_dir))
    removed = F.aggregate("runs", F.lit(0), lambda total, run: total + run["end"] - run["first"])
    return found.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        removed.cast("bigint").alias("n_removed"),
        F.size("runs").cast("bigint").alias("n_runs"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@_query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    found = align.aligned(documents(spark, sf_dir), *align.token_files())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def _terms_sql(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


SEARCH_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_terms_sql("text")}) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) CROSS JOIN s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_terms_sql("text")}) AS term FROM benchmark) GROUP BY item_id, term),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM d CROSS JOIN s),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {search.K}
"""


@_query("op12_lexical_search", SEARCH_SQL)
def op12_lexical_search(spark, sf_dir):
    return search.ranked(documents(spark, sf_dir), benchmark(spark, sf_dir))


@_query("op13_ngram_jaccard_join")
def op13_ngram_jaccard_join(spark, sf_dir):
    return jaccard.clustered(documents(spark, sf_dir))
