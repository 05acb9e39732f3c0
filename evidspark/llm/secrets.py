"""Secret scan in DataFrame functions only, with corpus-wide ownership of each value.

Candidates come from the contract's three expressions and, as an addition of the
method, from the fixed formats of well-known tokens and private key blocks. Each
value's hash is then counted over the whole corpus by distinct owners (the source)
and distinct repositories (the documents, or a column of your own): first per hash
and owner, then per hash, so a widely copied value meets in one task only as a few
partial counts. A value of one owner is live-looking; a value that several owners
share, or a placeholder by its letters, is an example.

A match's position is not given by Spark's functions, so it is rebuilt: the pieces
that split() leaves between matches and the matches themselves add up to the text.

A null text is empty and has no spans. A null owner counts as one owner of its own.
Repeated rows are scanned each on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidspark.runtime import materialize

#: Base kinds in the listed order, then the added ones: pattern, group of the value, least length of the value.
PATTERNS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
    "forge": ("gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "chat": ("xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    "web": ("eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 24),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
}
BASE = ("assign", "access", "hex")
PLACEHOLDER = "(?i)example|changeme|placeholder|your[_-]?|xxxx|123456|dummy|sample|test"


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, k, end, kind, value>> of one kind; empty where there is none."""
    pattern, group, least = PATTERNS[kind]
    order = list(PATTERNS).index(kind)
    empty = F.array().cast("array<struct<start:int,k:int,end:int,kind:string,value:string>>")

    def place(pieces: Column, whole: Column, values: Column) -> Column:
        ends = F.aggregate(
            F.transform(whole, lambda w, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(w).alias("n"), F.get(values, i).alias("v"))),
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, m: F.struct(
                (acc["at"] + m["gap"] + m["n"]).alias("at"),
                F.when(
                    F.length(m["v"]) >= least,
                    F.concat(
                        acc["out"],
                        F.array(F.struct((acc["at"] + m["gap"]).alias("start"), F.lit(order).alias("k"), (acc["at"] + m["gap"] + m["n"]).alias("end"), F.lit(kind).alias("kind"), m["v"].alias("value"))),
                    ),
                ).otherwise(acc["out"]).alias("out"),
            ),
        )
        return ends["out"]

    # Short hex runs are everywhere; only runs of the least length or longer are worth a place, and they never adjoin.
    pattern = "[0-9a-f]{24,}" if kind == "hex" else pattern
    found = place(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """row, doc_id, owner, repo, found: all spans of a row by start, then kind. Without a column owner_col all rows have one owner."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string") if owner_col in docs.columns else F.lit(None), F.lit("")).alias("owner"),
        F.coalesce(F.col(repo_col or id_col).cast("string"), F.lit("")).alias("repo"),
        text.alias("text"),
    )
    for kind in PATTERNS:
        rows = rows.withColumn(f"_{kind}", _spans(F.col("text"), kind))
    return rows.select("row", "doc_id", "owner", "repo", F.array_sort(reduce(lambda a, b: F.concat(a, b), [F.col(f"_{k}") for k in PATTERNS])).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_uses of every candidate value."""
    uses = found.select("owner", "repo", F.explode("found").alias("s")).select("owner", "repo", F.sha2(F.col("s.value"), 256).alias("hash"))
    by_repo = uses.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses"))


def _is(k: int):
    return lambda s: s["k"] == k


def _render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, most_owners: int = 1) -> DataFrame:
    """The op8 columns for every row, then n_live and n_example values and the most owners any of them has."""
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_col), "secrets")
    owned = ownership(found)
    each = found.select("row", F.explode("found").alias("s")).select("row", F.sha2(F.col("s.value"), 256).alias("hash"), F.col("s.value").rlike(PLACEHOLDER).alias("fake")).distinct()
    live = (F.col("n_owners") <= most_owners) & ~F.col("fake")
    verdict = each.join(owned, "hash").groupBy("row").agg(F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"), F.max("n_owners").alias("most_owners"))
    base = F.filter("found", lambda s: s["k"] < len(BASE))
    flat = found.select("row", "doc_id", *[F.size(F.filter("found", _is(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(_render(base), 256).alias("base_sha256"), _render(F.col("found")).alias("spans"))
    zero = F.lit(0).cast("bigint")
    return flat.join(verdict, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "most_owners")])
