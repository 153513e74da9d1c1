"""Near-duplicate documents by DartMinHash signatures and banded joins.

Each shingle of five words owns a region as wide as its weight. Hashed darts fall on the plane
of weight and rank, at a rate of one for each unit of area; a dart counts if it falls in the
region. Per coordinate of the signature the dart of least rank is kept, so two documents agree
on a coordinate with a probability equal to their weighted Jaccard similarity, and a document
needs only as many darts as its signature, not shingles times coordinates.

Documents that agree on a band meet in a bucket. In a bucket all are compared with one leader;
then documents that this left in different components are compared with each other in blocks,
unless their distances to the leader, by the triangle inequality, rule a link out. All
comparisons take the exact Jaccard similarity of the shingle sets, weighted as the signatures
are: a shingle that counts n times is n elements, the shingle and its number of occurrence.

Texts themselves are shuffled only where they may be dropped. Those whose shingles are needed are
picked by a map of bits of a fixed size, which lets some others pass; a join behind it drops these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gannet.llm import words as W
from gannet.llm.common import cut, drop
from gannet.llm.components import connected, least_labels

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares no band with probability (1 - 0.8 ** 6) ** 40, 5 in a million; one at 0.2 shares
#: one with 0.3 %, so documents with a passage in common seldom meet.
BANDS, ROWS = 40, 6
#: Texts of a bucket that are compared at once with as many others, and their shingles; texts that meet a leader in one task.
BLOCK, BLOCK_SHINGLES, LED = 512, 1 << 17, 64
#: Bits of the map by which texts are picked without a shuffle: 8 MB to broadcast, whatever the input. A full
#: map picks too many texts, which the join behind it drops.
MAP_BITS = 1 << 26

_POISSON = np.cumsum([0.36787944117144233 / x for x in np.cumprod([1.0, *range(1, 18)])])
_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def _throw(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts in the elements' regions with rank below limit (by document): document, rank, dart."""
    ranks = np.ceil(limit[doc]).astype(np.int64)
    cells = ranks * np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(element)), cells)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    rank, slab = nth % ranks[of], nth // ranks[of]
    # a cell is one unit of weight by one of rank; how many darts fall there depends on the element and the cell alone
    cell = W.mix(element[of] + rank.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + slab.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    n = np.searchsorted(_POISSON, _uniform(cell))
    at = np.repeat(np.arange(len(of)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    dart = W.mix(cell[at] + (nth + 1).astype(np.uint64) * np.uint64(W._P))
    high = rank[at] + _uniform(dart)
    wide = slab[at] + _uniform(W.mix(dart ^ np.uint64(0xA0761D6478BD642F)))
    hit = (high < limit[doc[of[at]]]) & (wide < weight[of[at]])
    return doc[of[at[hit]]], high[hit], dart[hit]


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k darts. doc: the document of each element, in order; documents without elements get zeros."""
    out = np.zeros((n_docs, k), dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo, darts = np.flatnonzero(total > 0), k * np.log(k) + 2 * k
    while len(todo):
        number = np.full(n_docs, -1)
        number[todo] = np.arange(len(todo))
        mine = number[doc] >= 0
        d, high, dart = _throw(element[mine], weight[mine], number[doc[mine]], darts / total[todo])
        slot = d * k + (W.mix(dart + np.uint64(1)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((high, slot))
        slot = slot[order]
        first = np.ones(len(slot), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        flat = np.zeros(len(todo) * k, dtype=np.uint64)
        flat[slot[first]] = dart[order[first]]
        filled = np.bincount(slot[first] // k, minlength=len(todo)) == k
        out[todo[filled]] = flat.reshape(-1, k)[filled]
        todo, darts = todo[~filled], darts * 2  # a coordinate without a dart: look higher
    return out


def shingles(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, how often each occurs, and its document; a shorter text is one shingle."""
    n, doc = words.counts(), words.doc()
    at, h = W.ngrams(words, SHINGLE)
    of = doc[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        few = np.array([W.mix(_sequence(words.hash[a:b]))[0] for a, b in zip(words.first[short], words.first[short + 1], strict=True)], dtype=np.uint64)
        h, of = np.concatenate([h, few]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    return h[begin], np.diff(np.append(begin, len(h))), of[begin]


def _sequence(h: np.ndarray) -> np.ndarray:
    return np.array([np.bitwise_xor.reduce(W.mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(W._P)))], dtype=np.uint64)


def _fingerprints(words: W.Words) -> np.ndarray:
    """Two 64-bit hashes of each text's sequence of words."""
    nth = (np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts())).astype(np.uint64)
    out = np.zeros((len(words.first) - 1, 2), dtype=np.uint64)
    some = words.counts() > 0
    for k in (0, 1):
        if some.any():
            out[some, k] = np.add.reduceat(W.mix(words.hash * np.uint64(2 * k + 1) + (nth + np.uint64(k)) * np.uint64(W._P)), words.first[:-1][some])
    return out


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _sign(weighting: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.batches(source, "text", 1 << 18):
            words = W.split(*W.utf8(batch.column(1)))
            element, times, doc = shingles(words)
            weight = times.astype(float) if weighting == "count" else np.ones(len(element))
            sig = signatures(element, weight, doc, batch.num_rows, BANDS * ROWS)
            band = np.tile(np.arange(BANDS, dtype=np.uint64), (batch.num_rows, 1))
            for r in range(ROWS):
                band = W.mix(band * np.uint64(W._P) + sig[:, r::ROWS])
            print_of = _fingerprints(words)
            empty = words.counts() == 0
            size = np.bincount(doc, weights=weight, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(print_of[:, k].view(np.int64), mask=empty) for k in (0, 1)], pa.array(size), _lists(band.ravel(), np.arange(0, band.size + 1, BANDS))], ["id", "f0", "f1", "size", "bands"]
            )

    return run


def _sets(weighting: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.batches(source, "text", 1 << 18):
            words = W.split(*W.utf8(batch.column(1)))
            element, times, doc = shingles(words)
            if weighting == "count":
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                element, doc = np.repeat(element, times), np.repeat(doc, times)
                element = np.where(nth > 0, W.mix(element + nth.astype(np.uint64) * np.uint64(W._P)), element)
                order = np.lexsort((element, doc))
                element = element[order]
            print_of = _fingerprints(words)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(print_of[:, k].view(np.int64)) for k in (0, 1)], _lists(element, ends)], ["id", "f0", "f1", "shingles"])

    return run


def _may_be_in(rows: DataFrame, of: Column, ids: DataFrame) -> DataFrame:
    """rows (columns that don't start with map_) and map_hit: whether `of` may be one of ids (column id). False is certain.

    A broadcast of MAP_BITS bits at most, and no shuffle of rows.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    known = ids.select(slot(F.col("id")).alias("slot")).select(F.bitmap_bucket_number("slot").alias("map_bucket"), F.bitmap_bit_position("slot").alias("bit"))
    bits = known.repartition("map_bucket").groupBy("map_bucket").agg(F.bitmap_construct_agg("bit").alias("map_bits"))
    bit = F.bitmap_bit_position(slot(of))
    byte = F.conv(F.hex(F.substring("map_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot(of)) == F.col("map_bucket"), "left").select(*rows.columns, hit.alias("map_hit"))


def _sets_of(docs: DataFrame, texts: DataFrame, need: DataFrame, weighting: str) -> DataFrame:
    """The shingle sets of the texts (id, f0, f1) that `need` names."""
    picked = _may_be_in(docs, docs["id"], need).where("map_hit").select("id", "text")
    sets = picked.mapInArrow(_sets(weighting), "id long, f0 long, f1 long, shingles array<long>").dropDuplicates(["id", "f0", "f1"])
    return cut(sets.join(texts.join(need, "id", "left_semi"), ["id", "f0", "f1"], "left_semi").select("id", "shingles"))


def _with_leader(group: pa.Table) -> pa.Table:
    """The similarity of each text of a block with the leader."""
    lead, member = group.filter(group["leads"]), group.filter(pc.invert(group["leads"]))
    out: list[tuple] = []
    if member.num_rows:
        sets = member["shingles"].combine_chunks()
        flat, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        for own in lead["shingles"]:
            own = np.sort(own.values.to_numpy())
            at = np.minimum(np.searchsorted(own, flat), max(len(own) - 1, 0))
            total = np.concatenate([[0], np.cumsum(own[at] == flat)])
            both = total[ends[1:]] - total[ends[:-1]]
            out.append((member["id"].to_numpy(), both / (np.diff(ends) + len(own) - both)))
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
    s = np.concatenate([x for _, x in out]) if out else np.zeros(0)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(np.full(len(a), group["leader"][0].as_py()), pa.int64()), "similarity": pa.array(s, pa.float64())})


def _similarity(sets: DataFrame, led: DataFrame) -> DataFrame:
    """led (a, its leader b) with their exact similarity.

    A leader's texts are dealt to blocks of about LED, each with a copy of the leader's set: no set
    travels once for each pair, and no task holds all that share a leader.
    """
    blocks = cut(led.groupBy(F.col("b").alias("leader")).agg(F.ceil(F.count("*") / LED).cast("int").alias("blocks")))
    dealt = led.join(blocks, led["b"] == blocks["leader"]).select("leader", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.col("a").alias("id"))
    members = dealt.join(sets, "id").select("leader", "block", "id", "shingles", F.lit(False).alias("leads"))
    leaders = blocks.join(sets, blocks["leader"] == sets["id"]).select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "shingles", F.lit(True).alias("leads"))
    return cut(members.union(leaders).groupBy("leader", "block").applyInArrow(_with_leader, "a long, b long, similarity double"), blocks)


def _overlaps(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many elements each two sets share, as sums of products of 0/1 matrices over `step` elements at a time."""
    element, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = times > 1
    column = (np.cumsum(shared) - 1)[number]
    row, column = row[shared[number]], column[shared[number]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(shared.sum()), step):
        part = slice(*np.searchsorted(column, [at, at + step]))
        has = np.zeros((len(sets), step), dtype=np.float32)
        has[row[part], column[part] - at] = 1
        out += has @ has.T
    return out


def _ask(group: pa.Table, similarity: float) -> np.ndarray:
    """Which texts of two blocks of a bucket have to be compared: of different components, not both of the leader's,
    with distances to the leader and sizes that don't rule a link out."""
    col = {c: group[c].to_numpy() for c in ("block", "component", "apart", "far", "size")}
    two = lambda f, x: f(x[:, None], x[None, :])
    ask = two(np.not_equal, col["component"]) & two(np.logical_or, col["apart"])
    ask &= np.abs(two(np.subtract, col["far"].astype(np.float32))) <= 1 - similarity + 1e-6
    ask &= two(np.minimum, col["size"]) >= similarity * two(np.maximum, col["size"]) - 1e-9
    if group["lo"][0].as_py() != group["hi"][0].as_py():
        ask &= two(np.not_equal, col["block"])
    return ask


def _asked(similarity: float):
    """The rows of a bucket that have to be compared with some other, so that only their sets travel."""

    def run(group: pa.Table) -> pa.Table:
        return group.take(pa.array(np.flatnonzero(_ask(group, similarity).any(axis=1))))

    return run


def _compare(similarity: float):
    """Compares texts as asked; returns which components are linked, never the pairs."""

    def run(group: pa.Table) -> pa.Table:
        ask = _ask(group, similarity)
        sets = [x.values.to_numpy() for x in group["shingles"]]
        size = np.array([len(x) for x in sets], dtype=np.float32)
        both = _overlaps(sets)
        x, y = np.nonzero(ask & (both >= np.float32(similarity) * (size[:, None] + size[None, :] - both) - np.float32(1e-3)))
        exact = both[x, y].astype(np.float64) / (size[x].astype(np.float64) + size[y] - both[x, y]) >= similarity
        component = group["component"].to_numpy()
        if not exact.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        node, label = least_labels(component[x[exact]], component[y[exact]])
        return pa.table({"a": pa.array(node), "b": pa.array(label)})

    return run


def _across(members: DataFrame, texts: DataFrame, known: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components that meet in a bucket, found in blocks of at most about BLOCK texts, or BLOCK_SHINGLES, each.

    Leaders are left out, having been compared with all. Two texts are compared if they aren't
    of one component nor both of the leader's, and neither their distances to the leader, by the
    triangle inequality, nor their sizes rule a link out.
    """
    of = F.coalesce("component", "id")
    placed = cut(members.join(found, "id", "left").select("band", "id", "leader", of.alias("component")))
    # buckets that still hold several components
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("band")
    rest = placed.join(mixed, "band").where("id != leader").join(known.select(F.col("a").alias("id"), F.col("b").alias("leader"), (1 - F.col("similarity")).alias("far")), ["id", "leader"])
    lead = found.select(F.col("id").alias("leader"), F.col("component").alias("lead"))
    rest = rest.join(lead, "leader", "left").withColumn("apart", F.col("component") != F.coalesce("lead", "leader")).drop("leader", "lead")
    rest = cut(rest.join(texts.select("id", "size").distinct(), "id"), placed)
    # where all left are of the leader's component there is nothing to compare
    sizes = cut(rest.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.max("apart").alias("any"), F.count("*").alias("n")).where("any and n > 1").select("band", "blocks"))
    dealt = rest.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = dealt.select("band", "lo", "hi", "block", "id", "component", "apart", "far", "size")
    asked = cut(dealt.groupBy("band", "lo", "hi").applyInArrow(_asked(similarity), dealt.schema), rest, sizes)
    return cut(asked.join(sets, "id").groupBy("band", "lo", "hi").applyInArrow(_compare(similarity), "a long, b long"), asked)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """One row for each id: doc_id, class_id (the smallest id of its class), kept (it is that id), n_rows.

    Documents of one class are joined by a chain of links: equal words in equal order, or a
    Jaccard similarity of their five-word shingles of at least `similarity` (a text of fewer
    words is one shingle). weighting "set" counts each shingle of a text once; "count" as often
    as it occurs, for signatures and comparisons alike. Null texts and texts without words link
    with nothing. Very long texts are read whole. Rows of one id are one document, of all their
    texts. Each null id stays a row of its own, with a null class, kept. Other columns are left
    out, so names can't clash. The result is a table in the shared folder.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = cut(docs.mapInArrow(_sign(weighting), "id long, f0 long, f1 long, size long, bands array<long>"))
    full = signed.where("id is not null and f0 is not null")
    texts = cut(full.groupBy("f0", "f1").agg(F.min("id").alias("id"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")))
    # copies follow the text that stands for them; ids with several texts join these
    named = cut(signed.where("id is not null").select(F.col("id").alias("doc_id"), "f0", "f1").join(texts.select("f0", "f1", F.col("id").alias("rep")), ["f0", "f1"], "left").select("doc_id", "rep"))
    ids = cut(named.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.min("rep").alias("rep"), F.max("rep").alias("last")))
    joined = named.join(ids.where("rep != last").select("doc_id", F.col("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").where("a != b").distinct()

    # one bucket for each band; buckets of one text are dropped
    entries = texts.select("id", F.explode("bands").alias("band"))
    buckets = cut(entries.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = cut(entries.join(buckets, "band"), buckets)
    led = cut(members.where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct())
    need = cut(led.select(F.col("a").alias("id")).union(led.select("b")).distinct())
    sets = _sets_of(docs, texts, need, weighting)
    known = _similarity(sets, led)
    drop(led, need)
    found = connected(joined.union(known.where(F.col("similarity") >= similarity).select("a", "b")))
    more = _across(members, texts, known, found, sets, similarity)
    drop(members, known, sets)
    if not more.isEmpty():
        first, found = found, connected(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
        drop(first)

    class_id = F.coalesce("component", "rep", "doc_id")
    classed = ids.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", class_id.alias("class_id"), (F.col("doc_id") == class_id).alias("kept"), "n_rows")
    null = F.lit(None).cast("long")
    unnamed = signed.where("id is null").select(null.alias("doc_id"), null.alias("class_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("n_rows"))
    return cut(classed.union(unnamed), signed, texts, named, ids, more, found)


def keep(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with one document of each class left: that of the smallest id; of its repeated rows, one.

    All columns stay as they were. Rows with a null id stay. Only rows that may have to go, as a
    map of bits of the ids tells, are shuffled with their columns, and once.
    """
    found = classes(docs, id_col, text)
    verdict = cut(found.where("doc_id is not null and (not kept or n_rows > 1)").select(F.col("doc_id").alias("id"), "kept"), found)
    by = F.col(id_col).cast("long")
    rows = _may_be_in(docs.select(F.struct("*").alias("row"), by.alias("by")), F.col("by"), verdict)
    stay = rows.where("not map_hit").select("row")
    asked = rows.where("map_hit").join(verdict.hint("merge"), F.col("by") == F.col("id"), "left").where("kept is null or kept").select("row", "by", "id")
    if verdict.where("kept").isEmpty():
        return stay.union(asked.select("row")).select("row.*")
    asked = cut(asked)
    return stay.union(asked.where("id is null").select("row")).union(asked.where("id is not null").dropDuplicates(["id"]).select("row")).select("row.*")
