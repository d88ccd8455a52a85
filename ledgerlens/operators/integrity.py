"""Content hashes, manifests and identity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import sweep

# Components of a batch, in hashing order.
COMPONENTS = ("data_hash", "annual_hash", "wiki_hash", "prompt_contract_hash", "prompt_bundle_hash")


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the JSON of the named columns in alphabetical order.

    Decides by content only; it is not the byte sequence another JSON writer would hash.
    """
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def batch_id(components: Mapping[str, Column] | None = None) -> Column:
    """First 24 hex digits over the component hashes; an absent component counts as empty."""
    parts = components or {c: F.col(c) for c in COMPONENTS}
    joined = F.concat_ws("\0", *[F.coalesce(parts[c], F.lit("")) for c in COMPONENTS])
    return F.substring(F.sha2(joined, 256), 1, 24)


def set_hash(files: DataFrame, by: Sequence[str], name: str = "name", sha: str = "sha256") -> DataFrame:
    """One digest per key over its set of (name, content), whatever the order.

    A hash tree: names fall into 65536 leaves by their own digest, leaves into
    256 branches.  Each step digests a short sorted list, so no task ever holds
    all files of one key.
    """
    def digest(parts: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(parts), "\n"), 256)

    line = F.concat_ws(":", F.col(name), F.col(sha))
    place = F.sha2(F.col(name), 256)
    leaves = files.groupBy(*by, F.substring(place, 1, 4).alias("__leaf")).agg(
        digest(F.collect_list(line)).alias("d"), F.count(F.lit(1)).alias("n")
    )
    tagged = F.concat_ws(":", "__leaf", "d")
    branches = leaves.groupBy(*by, F.substring("__leaf", 1, 2).alias("__branch")).agg(
        digest(F.collect_list(tagged)).alias("d"), F.sum("n").alias("n")
    )
    root = F.concat_ws(":", "__branch", "d")
    return branches.groupBy(*by).agg(digest(F.collect_list(root)).alias("set_hash"), F.sum("n").alias("files"))


def _sum_of_digests(rows: DataFrame, by: Sequence[str], digest: Column, sign: Column, files: Column) -> DataFrame:
    """Per key the eight 32-bit words of signed digests, each summed modulo 2**32, as one text of 64 hex digits."""
    word = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(11,0)")
    sums = rows.groupBy(*by).agg(*[F.sum(word(i) * sign).alias(f"__w{i}") for i in range(8)], F.sum(files * sign).alias("files"))
    text = [F.lpad(F.lower(F.hex(F.pmod(f"__w{i}", F.lit(1 << 32)).cast("bigint"))), 8, "0") for i in range(8)]
    return sums.where("files <> 0").select(*by, F.concat(*text).alias("set_hash"), F.col("files").cast("bigint").alias("files"))


def multiset_hash(files: DataFrame, by: Sequence[str], name: str = "name", sha: str = "sha256") -> DataFrame:
    """One digest per key over its files (name, content) that can be added to: set_hash and files.

    It is the sum of the files' own digests, word by word, so order does not matter, a file listed twice counts
    twice, partial sums combine before the exchange, and no list of files is ever held.  ``changed_hash`` keeps it
    up without the files that stay.  It tells changes by accident or edit; it does not stand against forged digests.
    A null name or hash counts as empty.
    """
    line = F.concat_ws(":", F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(sha), F.lit("")))
    return _sum_of_digests(files, by, F.sha2(line, 256), F.lit(1), F.lit(1))


def changed_hash(before: DataFrame, added: DataFrame, removed: DataFrame, by: Sequence[str]) -> DataFrame:
    """The hashes after files came and went: each argument as ``multiset_hash`` gives it; keys without files left go."""
    part = lambda df, sign: df.select(*by, "set_hash", "files", F.lit(sign).alias("__sign"))
    rows = part(before, 1).unionByName(part(added, 1)).unionByName(part(removed, -1))
    return _sum_of_digests(rows, by, F.col("set_hash"), F.col("__sign"), F.col("files"))


def component_mismatches(declared: DataFrame, recomputed: DataFrame, keys: Sequence[str], fields: Sequence[str] = (*COMPONENTS, "batch_id")) -> DataFrame:
    """One row per key and component whose declared hash is not the recomputed one."""
    d, r = declared.alias("d"), recomputed.alias("r")
    joined = d.join(r, list(keys))
    found = F.array_compact(F.array(*[
        F.when(~F.col(f"d.{f}").eqNullSafe(F.col(f"r.{f}")),
               F.struct(F.lit(f).alias("field"), F.col(f"d.{f}").alias("declared"), F.col(f"r.{f}").alias("recomputed")))
        for f in fields
    ]))
    return joined.select(*[F.col(k) for k in keys], F.inline(found))


def identity_mismatches(records: DataFrame, reference: DataFrame, keys: Sequence[str], fields: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Records whose identity fields differ from those of their snapshot, one row per field.

    A record without a snapshot mismatches in every field.
    """
    a, b = records.alias("a"), reference.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b, cond, "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = F.array_compact(F.array(*[
        F.when((text(f"a.{f}") != text(f"b.{f}")) | F.col(f"b.{keys[0]}").isNull(), F.lit(f)) for f in fields
    ]))
    return joined.select(*[F.col(f"a.{k}") for k in (*keys, *carry)], F.explode(found).alias("field"))


def manifest_problems(manifest: DataFrame, files: DataFrame, keys: Sequence[str] = ("ts_code", "run_id")) -> DataFrame:
    """Manifest entries against the files that are there: one row per entry and problem."""
    on = [*keys, "name"]
    # names are counted by an aggregate; a repeated name is one problem row per name
    listed = manifest.groupBy(*on).agg(
        F.count(F.lit(1)).alias("entries"), F.max("sha256").alias("sha256"), F.max("bytes").alias("bytes")
    )
    actual = files.select(*on, F.col("sha256").alias("actual_sha256"), F.col("bytes").alias("actual_bytes"))
    both = listed.join(actual, on, "full")
    listed_here, present = F.col("entries").isNotNull(), F.col("actual_sha256").isNotNull()
    checks = {
        "unexpected": ~listed_here,
        "missing": listed_here & ~present,
        "duplicate_name": F.col("entries") > 1,
        "sha256_malformed": listed_here & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "bytes_invalid": listed_here & ~F.coalesce(F.col("bytes") >= 0, F.lit(False)),
        "size_differs": listed_here & present & ~F.col("bytes").eqNullSafe(F.col("actual_bytes")),
        "hash_differs": listed_here & present & ~F.col("sha256").eqNullSafe(F.col("actual_sha256")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return both.select(*on, F.explode(found).alias("problem"))


def expected_names(companies: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """File names an archive must have: ``{code}`` in a pattern stands for the company."""
    names = F.array(*[F.replace(F.lit(p), F.lit("{code}"), F.col("ts_code")) for p in patterns])
    return companies.select("ts_code", "run_id", F.explode(names).alias("name"))


def name_differences(expected: DataFrame, found: DataFrame, keys: Sequence[str] = ("ts_code", "run_id")) -> DataFrame:
    """Names only expected or only found."""
    on = [*keys, "name"]
    e = expected.select(*on).distinct().withColumn("e", F.lit(1))
    f = found.select(*on).distinct().withColumn("f", F.lit(1))
    return e.join(f, on, "full").filter("e is null or f is null").select(
        *on, F.when(F.col("e").isNull(), "unexpected").otherwise("missing").alias("difference")
    )


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text`` without overlap."""
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (removed / F.length(part)).cast("bigint"))


def embedded_once(documents: DataFrame, sources: DataFrame, keys: Sequence[str], text: str = "text", part: str = "part", carry: Sequence[str] | None = None) -> DataFrame:
    """Sources a document does not contain exactly once; HTML comments do not count as text.

    All sources of a document are counted in one sweep over it.  ``carry`` names the columns of sources that are wanted, if not all.
    """
    shown = F.when(F.contains(F.col(text), F.lit("<!--")), F.regexp_replace(text, r"(?s)<!--.*?-->", "")).otherwise(F.col(text))
    return sweep.counted(documents.select(*keys, shown.alias("__doc")), sources, keys, "__doc", part, carry=carry).filter("times <> 1")


def verified_records(records: DataFrame, manifest: DataFrame, keys: Sequence[str], name: str = "name", content: str = "content") -> DataFrame:
    """Records whose content still has the hash its manifest lists, and only one listed record per key."""
    single = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(name).alias(name), F.max("sha256").alias("__sha"))
    joined = records.join(single.filter("__n = 1"), [*keys, name])
    return joined.filter(F.sha2(F.col(content), 256) == F.col("__sha")).drop("__n", "__sha")
