"""Registered queries of the llm operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (backoff, collocations, decontaminate, digests, divergence, jaccard, language, packing, quality, substrings, token_counts, token_files,
                            tool_calls)
from ledgerlens.llm.common import documents, shared_dir


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


#: Tools that the derived messages call.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False,
               "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}, "near": {"type": "string"}}},
    "count": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "unit": {"type": "string", "enum": ["word", "char"]}}},
    "join": {"type": "object", "required": ["parts"], "properties": {"parts": {"type": "array", "items": {"type": "string"}}, "near": {"type": "string"}}},
}


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations``; what the assistant says becomes one to three calls on the words it uses.

    Lengths decide names and faults: arguments without a key, of a wrong type, not allowed or not JSON.  A
    later call refers to the first of its message, and the first to one of the message before.  The next
    user message brings the results, some of them missing, some twice, some placed before their calls.
    """
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n, word = F.char_length("text"), F.split("text", r"\s+")[0]

    def call(k: int):
        seed = n + 7 * k
        ident = F.concat(F.lit("call_"), "turn", F.lit(f"_{k}"))
        other = F.concat(F.lit("call_"), "turn", F.lit("_0")) if k else F.concat(F.lit("call_"), F.col("turn") - 2, F.lit("_0"))
        near = F.when(F.lit(bool(k)) | (F.col("turn") > 2), F.struct(other.alias("$ref")))
        search = F.to_json(F.struct(near.alias("near"), F.when(seed % 7 != 0, word).alias("query"), (seed % 60).alias("limit"), F.when(seed % 19 == 0, True).alias("fast")))
        count = F.to_json(F.struct(F.when(seed % 5 != 0, "word").otherwise("line").alias("unit"), word.alias("text")))
        join = F.concat(F.lit('{ "parts": ["'), F.regexp_replace(word, r'["\\]', ""), F.when(seed % 11 == 0, '", 1.0').otherwise('"'), F.lit("]"),
                        F.when(seed % 13 == 0, "").otherwise(" }"))
        kind = seed % 3
        name = F.when(kind == 0, "search").when(kind == 1, "count").otherwise("join")
        return F.struct(ident.alias("id"), name.alias("name"), F.when(kind == 0, search).when(kind == 1, count).otherwise(join).alias("arguments"))

    spoken = F.col("role") == "assistant"
    calls = F.when(spoken, F.slice(F.array(call(0), call(1), call(2)), 1, n % 3 + 1))
    said = talks.select("conv_id", "turn", "role", "text", calls.alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))
    back = talks.where(spoken).select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), n % 3)).alias("k"))
    seed = F.char_length("text") + 7 * F.col("k")
    times = F.when(seed % 10 == 0, F.array().cast("array<long>")).when(seed % 23 == 0, F.array(F.col("turn") + 1, F.col("turn") + 3)) \
        .when(seed % 17 == 0, F.array(F.col("turn") - 1)).otherwise(F.array(F.col("turn") + 1))
    asked = F.concat(F.lit("call_"), back["turn"], F.lit("_"), "k")
    results = back.select("conv_id", F.explode(times).alias("at"), "text", asked.alias("tool_call_id")).select(
        "conv_id", F.col("at").alias("turn"), F.lit("tool").alias("role"), F.reverse("text").alias("text"),
        F.lit(None).cast(said.schema["tool_calls"].dataType).alias("tool_calls"), "tool_call_id")
    return said.unionByName(results)


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tool_calls.link(tool_messages(spark, sf_dir), SCHEMAS)
    return out.select("conv_id", "kind", "call_id", "turn", "nth", "status", "problems", F.col("behind.turn").alias("behind_turn"),
                      F.col("behind.nth").alias("behind_nth"), F.col("behind.from").alias("behind_from"), F.col("behind.steps").alias("steps"), "json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    token_files.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read(spark, folder)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.score(documents(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("log_score", "per_word")})


def op5_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same up to three words; op5_backoff stays at two, as its SQL says."""
    out = backoff.score(documents(spark, sf_dir), order=3)
    return out.withColumns({c: F.round(c, 4) for c in ("log_score", "per_word")})


def op6_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprint_edits(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substrings.deduplicate(docs)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(documents(spark, sf_dir))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_tool_calls, op3_token_files, op4_benchmark_leaks, op5_backoff, op5_backoff_trigrams, op6_digests, op7_language, op8_jaccard_join, op9_packing, op10_substrings,
                                  op11_divergence, op12_collocations, op13_quality)}

LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"list_filter(regexp_split_to_array({LETTERS}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""

BACKOFF_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i, unnest(list_prepend(NULL, w[:-2])) AS h FROM d),
uni AS (SELECT w, count(*) AS c FROM t GROUP BY w),
own_uni AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL),
bi AS (SELECT h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY ALL),
own_bi AS (SELECT doc_id, h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY ALL),
n AS (SELECT d.doc_id, len(w) AS n, greatest(1, (SELECT count(*) FROM t) - len(w)) AS rest FROM d),
s AS (SELECT t.doc_id, bi.c - own_bi.c AS both_c, hist.c - own_hist.c AS hist_c, uni.c - own_uni.c AS uni_c, t.h, n.rest
      FROM t JOIN n USING (doc_id) JOIN uni ON uni.w = t.w JOIN own_uni ON own_uni.doc_id = t.doc_id AND own_uni.w = t.w
      LEFT JOIN bi ON bi.h = t.h AND bi.w = t.w LEFT JOIN own_bi ON own_bi.doc_id = t.doc_id AND own_bi.h = t.h AND own_bi.w = t.w
      LEFT JOIN uni hist ON hist.w = t.h LEFT JOIN own_uni own_hist ON own_hist.doc_id = t.doc_id AND own_hist.w = t.h),
v AS (SELECT doc_id, sum(CASE WHEN both_c > 0 THEN ln(both_c / hist_c)
        ELSE CASE WHEN h IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(uni_c, 0.5)::DOUBLE / rest) END) AS ls,
        sum((h IS NOT NULL AND both_c = 0)::BIGINT) AS backs FROM s GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(backs, 0)::BIGINT AS n_backoffs, round(coalesce(ls, 0), 4) AS log_score,
       CASE WHEN n.n > 0 THEN round(ls / n.n, 4) END AS per_word
FROM n LEFT JOIN v USING (doc_id)
"""

TRIGRAMS_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, unnest(list_prepend(NULL, w)[1:len(w)]) AS h, unnest(list_prepend(NULL, list_prepend(NULL, w))[1:len(w)]) AS g FROM d),
uni AS (SELECT w, count(*) AS c FROM t GROUP BY w),
own_uni AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL),
bi AS (SELECT h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY ALL),
own_bi AS (SELECT doc_id, h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY ALL),
tri AS (SELECT g, h, w, count(*) AS c FROM t WHERE g IS NOT NULL GROUP BY ALL),
own_tri AS (SELECT doc_id, g, h, w, count(*) AS c FROM t WHERE g IS NOT NULL GROUP BY ALL),
n AS (SELECT d.doc_id, len(w) AS n, greatest(1, (SELECT count(*) FROM t) - len(w)) AS rest FROM d),
s AS (SELECT t.doc_id, t.h, t.g, n.rest, uni.c - own_uni.c AS c1, bi.c - own_bi.c AS c2, tri.c - own_tri.c AS c3,
      hist.c - own_hist.c AS h1, hist_bi.c - own_hist_bi.c AS h2
      FROM t JOIN n USING (doc_id) JOIN uni ON uni.w = t.w JOIN own_uni ON own_uni.doc_id = t.doc_id AND own_uni.w = t.w
      LEFT JOIN bi ON bi.h = t.h AND bi.w = t.w LEFT JOIN own_bi ON own_bi.doc_id = t.doc_id AND own_bi.h = t.h AND own_bi.w = t.w
      LEFT JOIN tri ON tri.g = t.g AND tri.h = t.h AND tri.w = t.w
      LEFT JOIN own_tri ON own_tri.doc_id = t.doc_id AND own_tri.g = t.g AND own_tri.h = t.h AND own_tri.w = t.w
      LEFT JOIN uni hist ON hist.w = t.h LEFT JOIN own_uni own_hist ON own_hist.doc_id = t.doc_id AND own_hist.w = t.h
      LEFT JOIN bi hist_bi ON hist_bi.h = t.g AND hist_bi.w = t.h
      LEFT JOIN own_bi own_hist_bi ON own_hist_bi.doc_id = t.doc_id AND own_hist_bi.h = t.g AND own_hist_bi.w = t.h),
b AS (SELECT *, (g IS NOT NULL AND c3 = 0)::BIGINT + (h IS NOT NULL AND c2 = 0)::BIGINT AS backs FROM s),
v AS (SELECT doc_id, sum(backs) AS backs, sum(backs * ln(0.4) + CASE WHEN c3 > 0 THEN ln(c3 / h2) WHEN c2 > 0 THEN ln(c2 / h1)
        ELSE ln(greatest(c1, 0.5)::DOUBLE / rest) END) AS ls FROM b GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(backs, 0)::BIGINT AS n_backoffs, round(coalesce(ls, 0), 4) AS log_score,
       CASE WHEN n.n > 0 THEN round(ls / n.n, 4) END AS per_word
FROM n LEFT JOIN v USING (doc_id)
"""

DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LETTERS} AS text FROM documents),
t AS (SELECT id, lang, source, unnest(list_filter(regexp_split_to_array(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.total), 0)::HUGEINT AS total FROM d
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.v) AS p
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
cq AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
q AS (SELECT cq.lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY cq.lang)::HUGEINT + 2 * v.v) AS q FROM cq JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(pv.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN pv ON pv.lang = x.lang AND pv.source = least(x.source, y.source) AND pv.item = greatest(x.source, y.source)),
terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms),
o AS (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 10
"""

COLLOCATIONS_SQL = rf"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, {LETTERS} AS text FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM w),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE len(g) > 1),
inner_ AS (SELECT lang, f AS held, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) AS g FROM c),
free AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.g = c.g AND 100 * i.held >= 100 * c.f)),
k AS (SELECT *, unnest(range(1, len(g))) AS cut FROM free),
s AS (SELECT k.lang, k.g, k.f AS a, n.n, k.cut, l.f AS l, r.f AS r, (1000 * k.f::HUGEINT * n.n) // (l.f::HUGEINT * r.f) AS score
      FROM k JOIN n USING (lang) JOIN f l ON l.lang = k.lang AND l.g = k.g[:k.cut] JOIN f r ON r.lang = k.lang AND r.g = k.g[k.cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (SELECT *, array_to_string(g, ' ') AS phrase FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM q WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op12_collocations": COLLOCATIONS_SQL, "op11_divergence": DIVERGENCE_SQL, "op8_jaccard_join": JACCARD_SQL, "op5_backoff": BACKOFF_SQL, "op5_backoff_trigrams": TRIGRAMS_SQL}
