"""The registered queries of this folder and the SQL they are checked against.

Each query applies its operator, with production parameters, to its whole
table, and derives the columns of its result from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    ann, bpe, decontaminate, exact_dedup, labelled, langid, line_dedup, mixing, near_dedup, quality, repair, runs, suffix_dedup, toxicity,
)
from .common import held_out, table

#: CRC-32 (polynomial 0xEDB88320, as a number below) of an ASCII string, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT))"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    return dict(QUERIES), dict(ORACLES)


@query("op1_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS unit, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), normal AS (
  SELECT doc_id, unit, line, regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM lines
), ranked AS (
  SELECT *, len(words) >= 1 AND row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, unit) > 1 AS gone
  FROM normal
), done AS (
  SELECT doc_id, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_spans, sum(CASE WHEN gone THEN length(line) ELSE 0 END) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (WHERE NOT gone), '') AS text
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       done.text
FROM documents d LEFT JOIN done USING (doc_id)
""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand earlier in the table, and how much it lost."""
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, u: n + u["end"] - u["start"])
    return found.select("doc_id", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "text")


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    import public_tokenizers

    coder = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = table(spark, sf_dir, "documents").select("doc_id", coder.round_trip(F.col("text")).alias("b"))
    return done.select("doc_id", bpe.n_tokens(F.col("b.ids")).alias("n_tokens"), F.sha2("b.ids", 256).alias("ids_sha256"),
                       F.sha2("b.bytes", 256).alias("decoded_sha256"))


@query("op3_source_mix", r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT)
              AS DOUBLE) / 4503599627370496.0 AS draw
  FROM documents
), totals AS (
  SELECT source, sum(size) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(3 * source_size AS BIGINT) AS cap,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM totals
), levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)
), fitted AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), (SELECT max(level) FROM levels) * weight) AS target
  FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM fitted
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       s.size * CAST(floor(r.rate) + CASE WHEN s.draw < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table with the words the mix takes of it."""
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op4_multiprobe_ann")
def multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op5_ordinal_quality")
def ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document.

    Grades from the labels: 0 for bad quality, 1 for good but toxic, 2 for
    the rest. A document is kept where grade 1 or better is likelier than not.
    """
    docs = table(spark, sf_dir, "documents")
    rating = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    sample = labelled.sample_labels(table(spark, sf_dir, "labels"), rating, ~held_out(F.col("doc_id")),
                                    quality.MAX_EXAMPLES, "quality")
    texts = quality.features_of(labelled.sample_texts(docs, sample)).select("doc_id", "label", "features")
    rows = texts.orderBy("doc_id").collect()  # at most MAX_EXAMPLES labelled rows
    model = quality.fit([(r["label"], r["features"]["at"], r["features"]["weight"]) for r in rows], grades=3)
    found = quality.graded(docs.select("doc_id", "text"), model)
    tails = F.col("quality.tails")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality.expected_grade").alias(
        "expected_grade"), tails[0].alias("p_good"), tails[1].alias("p_best"), (tails[0] >= 0.5).alias("kept"))


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs, ~held_out(F.col("doc_id"))))
    found = langid.labelled(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                        F.col("language.score").alias("score"), F.size("language.spans").alias("n_spans"))


@query("op7_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dedup.cluster(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document with the labelled examples that speak for it."""
    labels = table(spark, sf_dir, "labels")
    sample = labelled.sample_labels(labels, F.col("toxic"), ~held_out(F.col("doc_id")), toxicity.MAX_EXAMPLES, "toxic")
    found = toxicity.classify(table(spark, sf_dir, "documents"), sample)
    score = F.col("toxicity.score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
                        (score >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                        F.col("toxicity.evidence").alias("evidence"))


@query("op9_suffix_dedup")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 400 bytes repeat, and a digest of what is left."""
    rows, cuts = suffix_dedup.cut_texts(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    losses = cuts.select("key", gone.alias("gone"), F.size("spans").cast("long").alias("parts"), F.sha2("kept", 256).alias("sha"))
    none = F.lit(0).cast("long")
    return rows.join(losses, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("gone", none).alias("n_removed"), F.coalesce("parts", none).alias("n_spans"),
        F.coalesce("sha", "text_sha256").alias("kept_sha256"))


@query("op10_exact_dedup", """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), grouped AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM normal n JOIN grouped g USING (text_sha256)
""")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"), keep="largest")


@query("op11_periodic_runs", r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, """ + CRC32_SQL.format("CAST(doc_id AS VARCHAR)") + r""" AS h
  FROM documents
), placed AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM split
), tailed AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a, 1 + (n - CASE WHEN n > 0 THEN g % n ELSE 0 END) // (3 + g % 8) AS p FROM placed
), damaged AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
                    ELSE w END AS w
  FROM tailed
), words AS (
  SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM damaged
), grams AS (
  SELECT doc_id, unnest(range(n - 3)) AS i, unnest(list_transform(range(1, n - 2), lambda j: array_to_string(w[j:j + 3], ' '))) AS gram
  FROM damaged WHERE n > 3
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
), stretches AS (
  SELECT doc_id, p, min(i) AS start, count(*) + 3 + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs) GROUP BY doc_id, p, island
), runs AS (
  SELECT doc_id, start, length, min(p) AS period FROM stretches WHERE length >= greatest(12, 2 * p) GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_min([start, length, period], [-length, start, period]) AS best
  FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM words v WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = v.doc_id AND v.i >= r.start + r.period AND v.i < r.start + r.length)
  GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
       1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, after a tenth of them was given a tail that repeats."""
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = runs.add_runs(runs.repeat_tails(docs, F.floor(number / 10), number % 10 == 0)).select("doc_id", "periodic")
    every = F.col("periodic.runs")
    best = F.array_max(F.transform(every, lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))["run"]
    lines = F.array_join(F.transform(every, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size(every).cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size(every) > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))


@query("op12_decontamination", r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(10, len(w)) AS width,
         unnest(list_transform(range(0, len(w) - least(10, len(w)) + 1), lambda s: array_to_string(w[s + 1:s + least(10, len(w))], ' '))) AS win
  FROM item_words WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), doc_windows AS (
  SELECT doc_id, width, unnest(range(0, len(w) - width + 1)) AS s,
         unnest(list_transform(range(0, len(w) - width + 1), lambda s: array_to_string(w[s + 1:s + width], ' '))) AS win
  FROM doc_words CROSS JOIN (SELECT DISTINCT width FROM item_windows) WHERE len(w) >= width
), found AS (
  SELECT d.doc_id, d.s, d.width, i.item FROM doc_windows d JOIN item_windows i USING (win)
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS word FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark items cover, and the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contamination.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _best(*candidates: str) -> str:
    """SQL: the least of the structs (k: cost and audit, t: repaired lines) that are not null."""
    return f"list_sort(list_filter([{', '.join(candidates)}], lambda x: x IS NOT NULL))[1]"


def _step(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """SQL: a state after one edit."""
    text = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
    key = f"lpad(CAST(CAST(substr({state}.k, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}.k, 13) || '{letter}'"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'k': {key}, 't': {text}}} END"


def _inserted(names: list[str]) -> str:
    """SQL: the states (nothing, s, u, a) after inserting rows where that is cheaper."""
    once = {2: ["user:", (0, 1, 3)], 3: ["assistant:", (2,)]}
    cells = {}
    for q, (line, sources) in once.items():
        cells[q] = _best(names[q], *[_step(names[p], "5", "I", f"'{line}'") for p in sources])
    return f"{names[0]} AS p0, {names[1]} AS p1, {cells[2]} AS p2, {cells[3]} AS p3"


def _repair_sql() -> str:
    keep = "CASE WHEN NOT must AND initial = '{}' THEN {} END"
    role = "CASE WHEN NOT must THEN {} END"
    line, extra = "role || ':' || text", "CASE WHEN truncated THEN 5 ELSE 0 END"
    s = [f"s{q}" for q in range(4)]
    more = f"1 + {extra}"
    user, assistant = "'user:' || text", "'assistant:' || text"
    after = {
        0: [_step("s0", "2", "D")],
        1: [_step("s1", "2", "D"), keep.format("s", _step("s0", extra, "K", line))],
        2: [_step("s2", "2", "D")] + [keep.format("u", _step(p, extra, "K", line)) for p in ("s0", "s1", "s3")]
           + [role.format(_step(p, more, "R", user)) for p in ("s0", "s1", "s3")],
        3: [_step("s3", "2", "D"), keep.format("a", _step("s2", extra, "K", line)), role.format(_step("s2", more, "R", assistant))],
    }
    none = "CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[]))"
    return r"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, copy, CASE WHEN c = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, """ + CRC32_SQL.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + r""" % 20 AS c
        FROM conversations), (SELECT unnest([1, 2]) AS copy)
  WHERE c <> 0 AND (copy = 1 OR c = 3)
), placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
         coalesce(lag(role) OVER w, '') AS before, left(role, 1) AS initial
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faulty AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank FROM placed
), judged AS (
  SELECT *, NOT blank AND said > 1 AS duplicate, blank OR said > 1 AS must,
         NOT blank AND said = 1 AND NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS truncated,
         i > 1 AND left(before, 1) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM faulty
), counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS INT)) AS blank,
         sum(CAST(duplicate AS INT)) AS duplicate, sum(CAST(truncated AS INT)) AS truncated, sum(CAST(illegal AS INT)) AS illegal
  FROM judged GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'k': '000000000000', 't': CAST([] AS VARCHAR[])} AS s0, """ + f"{none} AS s1, {none} AS s2, {none} AS s3" + r"""
  FROM counted
  UNION ALL
  SELECT conv_id, i, """ + ", ".join(f"{_best(*after[q])} AS s{q}" for q in range(4)) + r"""
  FROM (SELECT q.conv_id, j.i, p0 AS s0, p1 AS s1, q.p2 AS s2, q.p3 AS s3, j.role, j.text, j.must, j.truncated, j.initial
        FROM (SELECT conv_id, i, """ + _inserted([f"p{q}" for q in range(4)]) + r"""
              FROM (SELECT conv_id, i, """ + _inserted(s) + r""" FROM walk)) q
        JOIN judged j ON j.conv_id IS NOT DISTINCT FROM q.conv_id AND j.i = q.i + 1)
), ended AS (
  SELECT conv_id, i, """ + _best("p0", "p3") + r""" AS best
  FROM (SELECT conv_id, i, """ + _inserted([f"p{q}" for q in range(4)]) + r""" FROM (SELECT conv_id, i, """ + _inserted(s) + r""" FROM walk))
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(substr(best.k, 1, 12), '0') AS BIGINT) AS cost,
       coalesce(substr(best.k, 13), '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = c.n
"""


@query("op13_conversation_repair", _repair_sql())
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation, after a fifth of the rows were damaged."""
    talks = table(spark, sf_dir, "conversations")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    rows = talks.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    damaged = rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    found = repair.repair(damaged)
    every = talks.select("conv_id").distinct()
    none = {**{c: F.lit(0).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")},
            "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left").select(
        every["conv_id"], *[F.coalesce(found[c], other).alias(c) for c, other in none.items()])
