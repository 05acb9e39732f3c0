"""Near-duplicate groups by bottom-k sketches of one hash function.

1. Every document becomes its set of hashed word shingles, its size and its sketch,
   the k smallest hashes. Documents with equal sets form a class, named by a 128-bit
   digest of the set, so a group of exact copies is one row from here on.
2. Inverted lists of retained values generate overlaps. Values are ordered rarest
   first, and a class enters only the lists of its first s - c + 1 values, where
   any pair similar enough shares at least c of s values but for a chance below
   1e-9: such a pair must meet in one of these lists. Frequent values come last.
3. Lists are split by size, as similar sets have similar sizes. A class leaves a
   list if too many of its shingles are its own, among all candidates, to be similar to
   anything in the list: with m of n shingles shared, a set of size k is out of reach
   unless m / (n + k - m) allows it.
4. Within a list every class is paired with one centre, never with all others.
   Pairs pass if the sketch of their union shows enough common values, and then by
   the exact Jaccard coefficient of their full sets. Links give components; lists
   whose classes are all in one component are done.
5. In an open list every member a is told by what sets it apart from a pivot c, the
   set D(a) of shingles that only one of the two has. Two members differ in
   |D(a)| + |D(b)| - 2 |D(a) & D(b)| shingles, so members that are both near to c are
   both linked to it, and all other similar pairs share a number of elements of D that
   their sizes tell. They meet in a list of one of their rarest elements of D, and there
   only members are paired whose remaining elements can still make up that number. So no
   link is lost, and no group is compared with itself.

Everything is DataFrames keyed by class; components are found by label propagation with
pointer jumping, each step written to the shared folder. Nothing is collected but
counts.

Words are lower-cased (A-Z) runs outside ASCII white space. A document with fewer
than `size` words is one shingle of all of them; one without words or text is empty
and linked with nothing. A row without an id is linked with nothing and kept; its
component is null. Rows that repeat an id are one document in `link`: what one of them
is linked with, all are. `keep_one` takes them as documents of their own, so that no text
goes without a copy that stays; rows that repeat both id and text stay or go together.
An empty table gives an empty result. Extra columns are not read and keep their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidspark.llm import arrowtext as at
from evidspark.runtime import forget, materialize, ship, tidy

#: Sketch size, and the common values that any pair of 0.8 has but for a chance below 1e-9.
K, COMMON = 24, 6
#: Bytes of text that are cut into words at a time, unless a single document has more.
SLICE_BYTES = 1 << 18


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per slice of documents: the first one, and each one's sorted distinct shingle hashes (63 bits)."""
    for i, j, words in at.documents(column, at.WORDS_LOWER, SLICE_BYTES):
        h = words.hashes()
        g = (at.grams(h, size) >> np.uint64(1)).astype(np.int64)
        out = []
        for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
            n = b - a
            if n >= size:
                own = np.sort(g[a : b - size + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif n:
                short = at.mix(at.grams(h[a:b], n) + np.uint64(n))
                out.append((short >> np.uint64(1)).astype(np.int64))
            else:
                out.append(np.empty(0, np.int64))
        yield i, out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _class_of(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def sketch(docs: DataFrame, size: int = 4, k: int = K) -> DataFrame:
    """docs (id, mark, text) to id, mark, n, cls (digest of the whole set, null if empty), sketch."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in shingle_sets(batch.column("text"), size):
                n = pa.array([len(s) for s in sets], pa.int64())
                own = [batch.column(c).slice(i, len(sets)) for c in ("id", "mark")]
                yield pa.RecordBatch.from_arrays([*own, n, pa.array([_class_of(s) for s in sets], pa.binary()), _lists([s[:k] for s in sets])], names=["id", "mark", "n", "cls", "sketch"])

    return docs.select("id", "mark", "text").mapInArrow(at.lean(work), f"id {docs.schema['id'].dataType.simpleString()}, mark bigint, n bigint, cls binary, sketch array<bigint>")


def full_sets(docs: DataFrame, size: int = 4) -> DataFrame:
    """docs (text) to cls, members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.binary()), _lists(sets)], names=["cls", "members"])

    return docs.select("text").mapInArrow(at.lean(work), "cls binary, members array<bigint>")


def _rarest(items: DataFrame, owner: list[str], within: list[str], length: str) -> DataFrame:
    """items (owner, within, e, d = number of the owner's elements, ...) that come among the owner's first ones, rarest first.

    Elements that one owner alone has come first; they count, but lead nowhere.
    """
    key = [*within, "e"]
    frequency = items.groupBy(*key).agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy(*owner)
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "e"))
    return items.join(frequency, key).withColumn("place", place).where(F.col("place") <= F.col(length)).drop("place", "df")


def prefixes(reps: DataFrame, k: int = K, common: int = COMMON) -> DataFrame:
    """reps (cls, n, sketch) to the inverted lists: v, cls, n."""
    least = F.greatest(F.lit(1), F.floor(F.col("d") * common / k))
    values = reps.select("cls", "n", F.size("sketch").alias("d"), F.explode("sketch").alias("e")).withColumn("upto", F.col("d") - least + 1)
    return _rarest(values, ["cls"], [], "upto").select(F.col("e").alias("v"), "cls", "n")


def bands(lists: DataFrame, percent: int) -> DataFrame:
    """The lists split by size: a class is in the band of its size and in the next one, so two of similar size always meet."""
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9)
    return lists.select(F.explode(F.array(F.xxhash64("v", band), F.xxhash64("v", band + 1))).alias("v"), "cls", "n")


def within_reach(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (v, cls, n) that may be similar to another member, by how many of their shingles any other candidate has."""
    single = sets.select("cls", F.explode("members").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("cls").alias("cls")).where("df = 1")
    alone = single.groupBy("cls").agg(F.count("*").alias("alone"))
    shared = lists.join(alone, "cls", "left").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0)))
    least = shared.groupBy("v").agg(F.min("n").alias("least"))
    # percent * (n + k - m) <= 100 * m for the smallest k of the list.
    return shared.join(least, "v").where((F.col("n") + F.col("least") - F.col("m")) * percent <= F.col("m") * 100).select("v", "cls", "n", "m")


def _possible(percent: int):
    """Whether sizes na, nb with ma, mb shared shingles leave room for the similarity."""
    most = F.least("ma", "mb")
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (most * 100 >= (F.col("na") + F.col("nb") - most) * percent)


def crowded(lists: DataFrame) -> DataFrame:
    """Lists of two members or more."""
    return lists.join(lists.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"), "v")


def mixed(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists of members of several components, each member with its component comp."""
    if labels is None:
        return lists.withColumn("comp", F.col("cls"))
    told = lists.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    open_ = told.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("v")
    return told.join(open_, "v")


def _near(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, k: int, common: int) -> DataFrame:
    """The pairs (a, b) that pass the union sketch and then the exact coefficient."""
    a = reps.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    b = reps.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("u", union).where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")) >= F.greatest(F.lit(1), F.floor(F.size("u") * common / k)))
    both = both.select("a", "b", "na", "nb")
    xa = sets.select(F.col("cls").alias("a"), F.col("members").alias("xa"))
    xb = sets.select(F.col("cls").alias("b"), F.col("members").alias("xb"))
    full = both.join(xa, "a").join(xb, "b").withColumn("i", F.size(F.array_intersect("xa", "xb")))
    return full.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def centres(lists: DataFrame, *first: str) -> DataFrame:
    """One member of each list, the smallest by the named columns: v, g, ng, mg."""
    order = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(first)], F.col("cls").alias("g"), F.col("n").alias("ng"), F.col("m").alias("mg"))
    return lists.groupBy("v").agg(F.min(order).alias("c")).select("v", "c.g", "c.ng", "c.mg")


def star(open_: DataFrame, centre: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's centre with the members of other components."""
    other = open_.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), "v", "comp")
    middle = centre.join(open_.select("v", F.col("cls").alias("g"), F.col("comp").alias("cg")), ["v", "g"])
    pairs = other.join(middle.select("v", F.col("g").alias("a"), F.col("ng").alias("na"), F.col("mg").alias("ma"), "cg"), "v")
    return _ordered(pairs.where("comp != cg").where(_possible(percent)))


def apart(open_: DataFrame, centre: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of open lists with what sets them apart from their list's pivot: g (the pivot), cls, n, m, w, d, need, rest.

    Lists with one pivot become one. d is the number of shingles that only the member or only the pivot
    has, w = (100 + percent) * d - (100 - percent) * n. Two members are similar if the sum of their w,
    less 2 * (100 + percent) for each element that both of these sets have, is not above 0. need is the
    fewest such elements with any member, at least one of the two not similar to the pivot. rest holds
    the member's elements that other members have too, rarest first, then the pivot's that it lacks.
    Members with too few of them are left out.
    """
    members = open_.join(centre.select("v", "g", "ng"), "v").where("cls != g").select("g", "ng", "cls", "n", "m").distinct()
    own = sets.select("cls", F.col("members").alias("x"))
    pivot = sets.select(F.col("cls").alias("g"), F.col("members").alias("y"))
    more, less = F.array_except("x", "y").alias("more"), F.array_except("y", "x").alias("less")
    told = members.join(own, "cls").join(pivot, "g").select("g", "ng", "cls", "n", "m", more, less).withColumn("d", F.size("more") + F.size("less"))
    told = told.withColumn("w", F.col("d") * (100 + percent) - F.col("n") * (100 - percent))
    far = F.col("w") > F.col("ng") * (100 - percent)
    # A hot pivot's members were read together; what follows goes by member.
    told = materialize(told.withColumn("far", far).repartition("cls", "g"), "apart")
    best = told.groupBy("g").agg(F.min("w").alias("any"), F.min(F.when(F.col("far"), F.col("w"))).alias("away")).where("away is not null")
    need = F.ceil((F.col("w") + F.when(F.col("far"), F.col("any")).otherwise(F.col("away"))) / (2 * (100 + percent)))
    # n - m of its shingles no other candidate has, so no other diff holds them.
    told = told.join(best, "g").withColumn("need", need).where("need <= d - (n - m)")
    items = told.select("g", "cls", F.explode("more").alias("e"))
    frequency = items.groupBy("g", "e").agg(F.count("*").alias("df")).where("df > 1")
    ranked = items.join(frequency, ["g", "e"]).groupBy("g", "cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "e"))), lambda x: x["e"]).alias("shared"))
    rest = F.concat(F.coalesce("shared", F.array().cast("array<bigint>")), F.array_sort("less"))
    return told.drop("more").join(ranked, ["g", "cls"], "left").withColumn("rest", rest).drop("shared", "less").where("need <= size(rest)")


def rarest_lists(ranked: DataFrame) -> DataFrame:
    """Members to lists (v, cls, n, m, w, left) of their rarest common elements; left counts the elements from this one on.

    A member enters those after which enough elements are left, so two similar ones meet in the list of
    the first element that both have.
    """
    reach = F.slice("rest", F.lit(1), F.size("rest") - F.greatest(F.col("need"), F.lit(1)) + 1)
    told = ranked.select("g", "cls", "n", "m", "w", F.size("rest").alias("s"), F.posexplode(reach).alias("i", "e"))
    return told.select(F.xxhash64("g", "e").alias("v"), "cls", "n", "m", "w", (F.col("s") - F.col("i")).alias("left"))


def with_room(open_: DataFrame, percent: int) -> DataFrame:
    """Members of a list whose w leaves room for a similar member, whichever it is."""
    best = open_.groupBy("v").agg(F.min("w").alias("least"), F.max("left").alias("most"))
    enough = F.col("w") + F.col("least") <= F.least("left", "most") * (2 * (100 + percent))
    return open_.join(best, "v").where(enough).drop("least", "most")


def member_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of several components in one list whose elements left may make them similar."""
    left = open_.select("v", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("w").alias("wa"), F.col("left").alias("la"), F.col("comp").alias("ca"))
    right = open_.select("v", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("w").alias("wb"), F.col("left").alias("lb"), F.col("comp").alias("cb"))
    room = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("wa") + F.col("wb") <= F.least("la", "lb") * (2 * (100 + percent)))
    return left.join(right, "v").where("ca != cb and a < b").where(room).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to cls, comp: the smallest class reachable, for every class that has a link."""
    ways = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ways")
    labels = materialize(ways.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("cls"), F.min("b")).alias("comp")), "labels")
    while True:
        best = ways.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        step = labels.join(best, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("next"))
        new = materialize(step.join(jump, "comp", "left").select("cls", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "labels")
        forget(labels)
        labels = new.select("cls", "comp")
        labels._evidspark_path = new._evidspark_path
        if new.where("old != comp").isEmpty():
            forget(ways)
            return labels


def _similar_links(reps: DataFrame, texts: DataFrame, size: int, percent: int, k: int, common: int) -> DataFrame | None:
    """Links (a, b) between classes whose components are those of all similar classes; None if there are none."""
    first = materialize(crowded(bands(prefixes(reps.select("cls", "n", "sketch"), k, common), percent)), "lists")
    wanted = reps.join(first.select("cls").distinct(), "cls", "left_semi").select("id", "mark")
    one = texts.join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark"])
    sets = materialize(full_sets(one, size), "sets")
    lists = materialize(crowded(within_reach(first, sets, percent)), "lists")
    forget(first)
    links, labels = None, None

    def add(found: DataFrame) -> None:
        nonlocal links, labels
        found = materialize(found, "links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            if labels is not None:
                forget(labels)
            labels = components(links)

    def check(pairs: DataFrame) -> None:
        add(_near(pairs, reps, sets, percent, k, common))

    lists = lists.withColumn("own", F.col("n") - F.col("m"))
    centre = materialize(centres(lists, "own"), "centres")
    check(star(mixed(lists, None), centre, percent))
    open_ = materialize(mixed(lists, labels), "open")
    if open_.isEmpty():
        return links
    lists = materialize(rarest_lists(apart(open_, centre, sets, percent)), "lists")
    open_ = materialize(mixed(lists, labels), "open")
    check(star(open_, centres(open_, "w"), percent))
    check(member_pairs(with_room(mixed(open_.drop("comp"), labels), percent), percent))
    return links


@tidy
def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, k: int, common: int, unite: bool) -> DataFrame:
    """id, mark (hash of the text), n_shingles, component_id, kept for every row; unite: rows that repeat an id are one document."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = materialize(sketch(texts, size, k), "sketches")
    best = F.min(F.struct("id", "mark"))
    reps = rows.where("id is not null and cls is not null").groupBy("cls", "n").agg(best.alias("r"), F.min("sketch").alias("sketch"))
    reps = materialize(reps.select("cls", "n", "r.id", "r.mark", "sketch"), "classes")
    links = _similar_links(reps, texts, size, percent, k, common)
    told = rows.select("id", "mark", "n", "cls")
    if unite:
        again = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("c"), F.min("cls").alias("lo")).where("c > 1 and lo is not null").select("id", "lo")
        again = materialize(again, "again")
        if not again.isEmpty():
            told = told.join(again, "id", "left").withColumn("cls", F.coalesce("cls", "lo"))
            same = told.where("cls != lo").select(F.col("lo").alias("a"), F.col("cls").alias("b"))
            links = same if links is None else links.unionByName(same)
            told = told.drop("lo")
    names = reps.select("cls", "id")
    if links is None or links.isEmpty():
        top = names.select("cls", F.col("id").alias("top"), F.col("cls").alias("top_cls"))
    else:
        labels = components(links)
        one = names.join(labels, "cls").groupBy("comp").agg(F.min(F.struct("id", "cls")).alias("t"))
        linked = labels.join(one, "comp").select("cls", "t")
        top = names.join(linked, "cls", "left").select("cls", F.coalesce("t.id", "id").alias("top"), F.coalesce("t.cls", "cls").alias("top_cls"))
    final = told.join(top.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c"), "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("top", "id"))
    kept = F.col("id") == comp
    if not unite:
        kept = kept & (F.col("top_cls").isNull() | (F.col("cls") == F.col("top_cls")))
    return materialize(final.select("id", "mark", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept")), "linked")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, k: int = K, common: int = COMMON) -> DataFrame:
    """id, n_shingles, component_id, kept for every row."""
    return _linked(docs, id_col, text_col, size, percent, k, common, True).drop("mark")


def digest(linked: DataFrame) -> DataFrame:
    """The op1 columns."""
    return linked.withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, that of the smallest id; columns as they came."""
    linked = _linked(docs, id_col, text_col, size, percent, K, COMMON, False)
    gone = linked.where("not kept").select("id", "mark").distinct()
    return docs.join(gone, (docs[id_col] == gone["id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["mark"]), "left_anti")
