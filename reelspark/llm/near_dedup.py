"""Near-duplicate detection: MinHash with tensored banding, then exact Jaccard similarity on full shingle sets.

Plain banding needs L tables of k minhashes each, L * k in all. Here two collections of `bands` short
bands (k/2 minhashes each) are computed, and a table's key is a pair of one band from either collection:
bands^2 tables from 2 * bands * k/2 minhashes. Two sets meet if any band of the first collection and any
of the second agree, so with rows = 2 and bands = 8 a pair at similarity s is missed with probability
1 - (1 - (1 - s^2)^8)^2, which is 0.0006 at s = 0.8 and 0.00001 at s = 0.9.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import lean, only_ids, stored, text_key, without
from reelspark.llm.components import connected_components
from reelspark.llm.shingles import mix, shingle_sets, shingles

#: A parity sketch has at least 4 bits for each shingle, within these bounds (powers of two). They change no result.
SKETCH_BITS = (4096, 65536)
#: Texts are worked on in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Members of a block; a larger bucket is compared as pairs of blocks.
BLOCK = 1024
#: Pairs that are tried first: of a node with its buckets' leaders, and of two components. What is left over is tried afterwards.
FIRST = 4


def _grouped(ids: list, texts: list, most: int = GROUP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most or i + 1 == len(texts):
            yield ids[at : i + 1], [x or b"" for x in texts[at : i + 1]]
            at, size = i + 1, 0


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """A parity sketch of each set: each shingle turns one bit over.

    The bits in which two sketches differ are never more than the shingles that only one of the sets has. A
    sketch folded in two, half on half, is the sketch of half the length.
    """
    out: list[bytes] = [b""] * len(sets)
    least, most = SKETCH_BITS
    bits = np.array([min(most, max(least, 1 << (4 * len(s) - 1).bit_length())) if len(s) else least for s in sets], dtype=np.int64)
    for n in np.unique(bits).tolist():
        at = np.flatnonzero(bits == n).tolist()
        step = max(1, (1 << 21) // n)
        for part in (at[i : i + step] for i in range(0, len(at), step)):
            owner = np.repeat(np.arange(len(part)), [len(sets[i]) for i in part])
            place = mix(np.concatenate([sets[i] for i in part]) + np.uint64(0x27D4EB2F165667C5)) & np.uint64(n - 1)
            count = np.bincount(owner * n + place.astype(np.int64), minlength=len(part) * n)
            odd = np.packbits((count & 1).astype(np.uint8).reshape(len(part), n), axis=1)
            for i, row in zip(part, odd, strict=True):
                out[i] = row.tobytes()
    return out


def _folded(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, dtype=np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def apart(odd: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches i and j differ, the longer of two folded to the length of the other."""
    size = np.array([len(x) for x in odd], dtype=np.int64)
    common, out = np.minimum(size[i], size[j]), np.zeros(len(i), dtype=np.int64)
    for n in np.unique(common).tolist():
        at = np.flatnonzero(common == n)
        used, where = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
        x = np.stack([_folded(odd[k], n) for k in used.tolist()]).view(np.uint64)
        for a in range(0, len(at), 4096):
            b = min(len(at), a + 4096)
            out[at[a:b]] = np.bitwise_count(x[where[a:b]] ^ x[where[len(at) + a : len(at) + b]]).sum(axis=1)
    return out


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, h1, h2, sig, odd): a hash of the text, the set's size, a 128-bit digest of all words in their order, minhashes and parity sketch."""
    n_hashes = 2 * bands * rows
    schema = "doc_id long, text_key long, n_shingles long, h1 long, h2 long, sig binary, odd binary"

    def run(batches):
        mult, add = _factors(n_hashes)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for ids, texts in _grouped(rows, batch.column(2).cast(pa.binary()).to_pylist()):
                sets = list(shingle_sets(texts, size))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                sig = np.full((len(sets), n_hashes), 0xFFFFFFFF, dtype=np.uint32)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for k in range(n_hashes):
                        sig[full, k] = np.minimum.reduceat((every * mult[k] + add[k]) >> np.uint64(32), begin)
                # bytes are split at the white space that words are told apart by
                digest = np.frombuffer(b"".join(hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts), dtype=np.int64).reshape(-1, 2)
                cols = [[i for i, _ in ids], [k for _, k in ids], n, digest[:, 0], digest[:, 1]]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in cols], pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(sketches(sets), pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "h1", "h2", "sig", "odd"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def tensored_keys(classes: DataFrame, rows: int, bands: int) -> DataFrame:
    """(key, place, node): for each class bands^2 table keys, each from one band of either collection; place is the table."""

    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(nodes), 4096):
                part = nodes[at : at + 4096]
                sig = np.frombuffer(b"".join(batch.column(1).slice(at, 4096).to_pylist()), dtype=np.uint32).reshape(len(part), 2, bands, rows).astype(np.uint64)
                band = np.zeros((len(part), 2, bands), dtype=np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(0xC2B2AE3D27D4EB4F) + sig[:, :, :, r])
                place = np.arange(bands * bands, dtype=np.uint64).reshape(1, bands, bands)
                key = mix(mix(band[:, 0, :, None] + place) + band[:, 1, None, :] * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(place.reshape(-1).astype(np.int32), len(part))), pa.array(np.repeat(part, bands * bands))], names=["key", "place", "node"])

    return classes.select("node", "sig").mapInArrow(lean(run), "key long, place int, node long")


def verified(pairs: DataFrame, texts_of: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have 100 * intersection >= percent * union; `texts_of` has node and text.

    Hashes of the shingles rule pairs out; what they leave is confirmed on the words themselves.
    """

    def run(batches):
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            texts = [batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)]
            keep, last, at = [], (None, None), 0
            while at < len(ids[0]):
                end, room = at, GROUP_BYTES
                while end < len(ids[0]) and (room > 0 or end == at):
                    room -= len(texts[0][end] or b"") + len(texts[1][end] or b"")
                    end += 1
                of_a = shingle_sets([t or b"" for t in texts[0][at:end]], size)
                for i, x in enumerate(of_a, at):
                    if last[0] != ids[1][i]:
                        last = ids[1][i], next(shingle_sets([texts[1][i] or b""], size))
                    y = last[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both) > 0:
                        words = [shingles(t or b"", size) for t in (texts[0][i], texts[1][i])]
                        both = len(words[0] & words[1])
                        if 100 * both >= percent * (len(words[0]) + len(words[1]) - both):
                            keep.append(i)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in ids], names=["a", "b"])

    nodes = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{name}-nodes")
    texts = stored(texts_of(nodes), f"{name}-texts")
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def star_pairs(members: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the FIRST likeliest of its buckets' leaders, as far as any are likely.

    `members` has key, node and the bucket's leader: the member with the smallest hash of node and bucket, so that a
    node meets different leaders in its buckets. Likely: minhashes agree as they do for five of six pairs at
    the threshold. What is passed over here is left to `across`.
    """
    stars = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    rows = stars.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x"), F.col("n_shingles").alias("n")), "a")
    rows = rows.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y"), F.col("n_shingles").alias("m")), "b")
    rows = rows.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for c in (2, 3))
                same, n, s = (x == y).sum(axis=1), x.shape[1], percent / 100
                keep = np.flatnonzero(same >= n * s - (n * s * (1 - s)) ** 0.5)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep)) for c in (0, 1)], pa.array(same[keep].astype(np.int32))], names=["a", "b", "same"])

    agreeing = rows.mapInArrow(lean(run), "a long, b long, same int")
    # no more than there are tables
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("same")).alias("same"), "b"))), 1, FIRST)
    return agreeing.groupBy("a").agg(ranked.alias("best")).select("a", F.explode("best.b").alias("b"))


def across(placed: DataFrame, sig: DataFrame, rows: int, bands: int, percent: int, first: int | None) -> DataFrame:
    """(a, b, of_a, of_b, share, more): pairs of nodes in different components that meet in a bucket and that sizes, parity sketches and minhashes leave possible.

    Sizes and sketches are exact bounds: at the threshold at most (100 - percent) / (100 + percent) of both sizes
    together lie outside the intersection. Minhashes must agree no less than 6.5 standard deviations below what is
    expected there, which loses one such pair in a billion. A pair is made in the first of the tables in which it
    meets. Pairs are sought within sorted runs of a bucket and never emitted before these tests; a bucket of more
    than BLOCK members is dealt as pairs of blocks, and members of its largest component are not set against each other.
    With `first`, a run gives so many pairs of two components, those of the smallest share of differing bits, and
    `more` tells that it has others.
    """
    of = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = of.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    large, few = F.col("n") > BLOCK, F.ceil((F.col("n") - F.col("top.n")) / BLOCK)
    mixed = mixed.select("key", F.col("top.component").alias("top"), F.when(large, few).otherwise(1).cast("int").alias("few"), F.when(large, F.ceil(F.col("top.n") / BLOCK)).otherwise(0).cast("int").alias("many"))
    mixed = stored(mixed, "near-mixed")
    dealt = placed.join(mixed, "key")
    in_top = (F.col("many") > 0) & (F.col("component") == F.col("top"))
    at = F.when(in_top, F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int")
    dealt = dealt.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_top, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = dealt.select("key", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at", "place", "node", "component")
    wide = dealt.join(sig, "node").select("key", "low", "high", "at", "place", "node", "component", "n_shingles", "sig", "odd")
    wide = wide.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    n_hashes, s = 2 * rows * bands, percent / 100
    least = max(0, int(n_hashes * s - 6.5 * (n_hashes * s * (1 - s)) ** 0.5))

    def met(t: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(begins)
        low, high, at, place, node, component, n = (t[c].to_numpy() for c in ("low", "high", "at", "place", "node", "component", "n_shingles"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint32).reshape(len(n), n_hashes)
        band = sig.reshape(len(n), 2, bands, rows)
        odd, found = t["odd"].to_pylist(), []
        for far in range(1, len(n)):
            i = np.flatnonzero(group[far:] == group[:-far])
            if not len(i):
                break
            j = i + far
            ok = (component[i] != component[j]) & ((low[i] == high[i]) | (at[i] != at[j])) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
            i, j = i[ok], j[ok]
            ok = (sig[i] == sig[j]).sum(axis=1) >= least
            i, j = i[ok], j[ok]
            table = (band[i] == band[j]).all(axis=3).argmax(axis=2)
            ok = place[i] == table[:, 0] * bands + table[:, 1]
            i, j = i[ok], j[ok]
            if len(i):
                bits = apart(odd, i, j)
                ok = bits * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
                found.append(np.stack((i[ok], j[ok], bits[ok])))
        i, j, bits = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        share, more = bits / (n[i] + n[j]), np.zeros(len(i), dtype=bool)
        swap = component[i] < component[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if first is not None and len(i):
            order = np.lexsort((node[j], node[i], share, component[j], component[i]))
            i, j, share = i[order], j[order], share[order]
            begin = np.concatenate(([True], (component[i][1:] != component[i][:-1]) | (component[j][1:] != component[j][:-1])))
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(begin, np.arange(len(i)), 0))
            over = np.concatenate((rank[1:] == first, [False]))
            keep = rank < first
            i, j, share, more = i[keep], j[keep], share[keep], over[keep]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], component[i], component[j], share, more)], names=["a", "b", "of_a", "of_b", "share", "more"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            of = [t[c].to_numpy() for c in ("key", "low", "high")]
            begins = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in of], axis=0)))
            last = int(np.flatnonzero(begins)[-1])
            if last:
                yield met(t.slice(0, last), begins[:last])
            held = t.slice(last)
        if held is not None:
            yield met(held, np.arange(held.num_rows) == 0)

    return wide.mapInArrow(lean(run), "a long, b long, of_a long, of_b long, share double, more boolean")


def _contracted(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(node, component) of all nodes linked so far, after `links` have been added; only components that they join are worked on."""
    if links.isEmpty():
        return labels
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    late = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = stored(connected_components(late, name), f"{name}-joined")
    whole = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("low")), "component", "left").select("node", F.coalesce("low", "component").alias("component"))
    new = joined.withColumnRenamed("id", "node")
    return stored(whole.union(new.join(labels, "node", "left_anti")), f"{name}-found")


def near_rows(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, rows: int, bands: int) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, n_shingles, component_id and stays (text_key of the row that stays)."""
    sigs = stored(signatures(docs, id_col, text_col, size, rows, bands), "near-signatures")
    sets = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    sig = classes.select("node", "n_shingles", "sig", "odd")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """One text of each node."""
        reps = stored(only_ids(classes.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key")), nodes, "node"), "near-reps")
        named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
        few = only_ids(named, reps.select("doc_id", "text_key"), ["doc_id", "text_key"])
        return few.join(reps, ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "text")

    keys = tensored_keys(sig, rows, bands)
    met = keys.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("leader"), F.count(F.lit(1)).alias("n"))
    met = stored(met.where("n > 1").select("key", "leader"), "near-buckets")
    members = stored(keys.join(met, "key").select("key", "place", "node", "leader"), "near-members")
    stars = stored(star_pairs(members, sig, percent), "near-stars")
    links = stored(verified(stars, texts_of, size, percent, "near-first"), "near-first-links")
    labels = stored(connected_components(links, "near-first"), "near-first-found").withColumnRenamed("id", "node")

    def placed() -> DataFrame:
        return members.join(labels, "node", "left").select("key", "place", "node", F.coalesce("component", "node").alias("component"))

    def join_links(pairs: DataFrame, name: str) -> DataFrame:
        return _contracted(labels, stored(verified(pairs, texts_of, size, percent, name), f"{name}-links"), name)

    before = stored(placed(), "near-placed")
    seen = stored(across(before, sig, rows, bands, percent, FIRST), "near-across")
    rank = F.row_number().over(Window.partitionBy("of_a", "of_b").orderBy("share", "a", "b"))
    best = stored(seen.withColumn("rank", rank).where(F.col("rank") <= FIRST).select("a", "b"), "near-best")
    labels = join_links(best, "near-second")
    # Two components that have other pairs than those tried, and that nothing has joined
    now = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"now_{c}"))
    left = seen.groupBy("of_a", "of_b").agg((F.bool_or("more") | (F.count(F.lit(1)) > FIRST)).alias("more")).where("more")
    left = left.join(now("of_a"), "of_a", "left").join(now("of_b"), "of_b", "left").where("coalesce(now_of_a, of_a) <> coalesce(now_of_b, of_b)")
    left = stored(left.select(F.explode(F.array("of_a", "of_b")).alias("was")).distinct(), "near-left")
    if not left.isEmpty():
        again = only_ids(before.withColumn("was", F.col("component")), left, "was").select("key", "place", "node").join(labels, "node", "left")
        again = stored(again.withColumn("component", F.coalesce("component", "node")), "near-again")
        labels = join_links(stored(across(again, sig, rows, bands, percent, None).select("a", "b"), "near-rest"), "near-third")

    # the smallest id, and its text, of each component
    own = classes.select("h1", "h2", "node", "rep").join(labels, "node", "left")
    low = own.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    own = own.join(low, "component", "left").withColumn("rep", F.coalesce("low", "rep"))
    out = sigs.drop("sig", "odd").join(own.select("h1", "h2", "rep"), ["h1", "h2"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("rep.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.when(linked, F.col("rep.text_key")).otherwise(F.col("text_key")).alias("stays"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rows: int = 2, bands: int = 8
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D) after A-Z are lower-cased; a set has
    the distinct shingles of `size` words (a shorter text: all its words as one). Documents are linked at
    100 * intersection >= percent * union; component_id is the smallest id reachable by links. Null and
    empty texts and those of white space have no shingles and link with nothing. Ids should be unique;
    different texts under one id are linked each by itself. Rows without an id link with nothing and stay.
    Other columns are ignored; an empty table gives no rows.

    Texts of the same words in the same order are one class (by a 128-bit digest of them) and need no pairs. Each
    class is first verified against the likeliest of its buckets' leaders, a random member each; a group of copies is
    then nearly one component, at a cost in proportion to its members. Next, of every two components that sizes,
    sketches and minhashes still leave possible, the closest pairs are verified, and last, of those that are apart
    even so, all pairs. What is lost is what the tables miss (see above) and what the bound on equal minhashes gives up, one in a
    billion of the pairs at the threshold. In a bucket of many texts that are alike but under the threshold,
    sketches of all members outside the largest component are compared with all others, in blocks and
    without emitting pairs; that is the one cost that grows with the square of such a group.
    """
    out = near_rows(docs, id_col, text_col, size, percent, rows, bands)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rows: int = 2, bands: int = 8) -> DataFrame:
    """`docs` with one document of each group of near copies; same columns.

    Of a group the smallest id stays, of different texts under that id one. Rows without an id, and those without
    words, stay; rows that repeat both id and text share one fate.
    """
    out = near_rows(docs, id_col, text_col, size, percent, rows, bands)
    out = out.where("doc_id <> component_id or text_key <> stays").select("doc_id", "text_key").distinct()
    return without(docs, out, {"doc_id": F.col(id_col).cast("long"), "text_key": text_key(text_col)})
