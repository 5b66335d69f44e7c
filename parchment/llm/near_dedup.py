"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import corpus_size, documents, durable, few, groups_for, kept, release, turn
from parchment.llm.components import components
from parchment.llm.tiles import Forest, meetings, products
from parchment.llm.words import Words, mixed, parts

#: Words of a shingle; bands and samples of a band; least similarity.
SIZE, BANDS, ROWS, THRESHOLD = 5, 16, 4, 0.8
#: Entries of the table of random variates of each sample, as a power of two.
TABLE = 15
#: Bytes of text of one group of documents, of hashes in one range, members by one leader's text.
GROUP, RANGE, FAN = 4 << 20, 8 << 20, 128


def _variates(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), beta ~ U(0, 1), and a multiplier for each sample."""
    g = np.random.default_rng(20100213)
    shape = (samples, 1 << TABLE)
    return (
        g.gamma(2.0, size=shape).astype(np.float32),
        np.log(g.gamma(2.0, size=shape)).astype(np.float32),
        g.random(size=shape, dtype=np.float32),
        g.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
    )


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 as unsigned integers of the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.int32).astype(np.int64)
    bits = np.where(bits < 0, ~bits, bits | np.int64(1 << 31)) & np.int64(0xFFFFFFFF)
    return bits.astype(np.uint64) << np.uint64(32)


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """uint64[count, sets]: improved consistent weighted samples of weighted sets.

    For sample k an element of weight w takes t = floor(ln w / r + beta) and
    ln a = ln c - r (t - beta + 1); the element with the least a is drawn, together with its t.
    The pair is kept as (ln a, 32 bits of the element): ln a names t for a given element. Two
    sets draw the same with a probability of their weighted Jaccard similarity. An element's
    variates stand in a table at its hash times the sample's multiplier.
    """
    r, lnc, beta, factor = kept("near_dedup", count, lambda: _variates(count))
    logs = np.log(weights).astype(np.float32)
    usual = np.float32(np.median(logs)) if len(logs) else np.float32(0)
    odd = np.flatnonzero(logs != usual)
    low = hashes & np.uint64(0xFFFFFFFF)
    out = np.empty((count, len(starts)), np.uint64)

    def lna(k: int, at, w):
        t = np.floor(w / r[k][at] + beta[k][at])
        return lnc[k][at] - r[k][at] * (t - beta[k][at] + np.float32(1))

    for k in range(count):
        at = ((hashes * factor[k]) >> np.uint64(64 - TABLE)).astype(np.int32)
        drawn = _ordered(lna(k, slice(None), usual))[at] | low
        if len(odd):
            drawn[odd] = _ordered(lna(k, at[odd], logs[odd])) | low[odd]
        out[k] = np.minimum.reduceat(drawn, starts)
    return out


def _vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, tf) by shingle, then text; and a 128-bit key of each text's words as uint64[texts, 2]."""
    n = len(texts)
    whole, shingles, key = [], [], np.zeros((n, 2), np.uint64)
    for low, high in parts(texts):
        w = Words(texts.slice(low, high - low))
        h, t = w.shingles(SIZE)
        whole.append(t + low)
        shingles.append(h)
        place = (np.arange(len(w.hash)) - np.repeat(w.text_at[:-1], np.diff(w.text_at))).astype(np.uint64)
        for c, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
            each = mixed(w.hash ^ mixed(place * np.uint64(2) + np.uint64(c) ^ np.uint64(salt)))
            total = np.concatenate([[np.uint64(0)], np.cumsum(each)])
            key[low:high, c] = total[w.text_at[1:]] - total[w.text_at[:-1]] + np.diff(w.text_at).astype(np.uint64)
    text = np.concatenate(whole) if whole else np.zeros(0, np.int64)
    h = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    h, text = h[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
    return text[first], h[first], np.diff(np.concatenate([first, [len(h)]])), key


def _runs(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)


def _binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def idf_codes(df: np.ndarray, n: int) -> np.ndarray:
    """idf = 1 + ln((n + 1) / (df + 1)) / ln(n + 1), from 1 to 2, in 255 steps above 1."""
    return np.clip(np.rint(255 * np.log((n + 1) / (df + 1.0)) / math.log(n + 1)), 0, 255).astype(np.uint8)


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per doc_id: doc_id, class_id (the least doc_id of its class), class_size, links
    (verified pairs that name this document), kept (doc_id = class_id).

    A document is the multiset of its runs of five words (lower case, letters and digits), each
    with weight tf * idf; idf counts all documents and lies between 1 and 2, so that neither
    the size of the corpus nor that of a group of copies outweighs what a text says. Documents
    are linked if their weighted Jaccard similarity is at least `threshold`, and classes are
    the connected components of the links.

    1. Documents fall by a hash of doc_id into groups of a few megabytes. Each group sends its
       distinct shingles, packed by ranges of the hash space, and gets back one byte of idf for
       each: document frequencies are exact but for chance collisions of 48 bits within a range,
       and a shingle of a third of all documents is one number of each group.
    2. Documents with the same words form one class before anything else; one of them goes on.
    3. Consistent weighted samples make `bands` keys of `rows` samples. In each bucket every
       document is paired with the least one only, and the similarity of these pairs computed
       from whole texts. The leader's text is dealt to as many tasks as its members need.
    4. Buckets that still hold several components go on: all pairs across their components are
       compared, tile by tile (tiles.meetings). So every pair that shares a band is verified or
       already connected.

    Texts without words form one class. Null text counts as empty. Rows that repeat a doc_id are one
    document with the last of their texts; rows without doc_id are left out. An empty table gives an empty
    result. Further columns of any name are ignored. State between the steps is checkpointed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = documents(docs, id_col, text_col).where("doc_id IS NOT NULL")
    n, size = corpus_size(base)
    profile = _profiles(base, n, size, bands, rows, kind)
    release(docs.sparkSession)
    first = profile.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = durable(first)
    buckets = (
        profile.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        .select("doc_id", F.explode(F.array_distinct("bands")).alias("bucket"))
    )
    leaders = buckets.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = durable(buckets.join(leaders, "bucket").select("bucket", "doc_id", "leader", "n"))
    codes = profile.select(F.col("doc_id").alias("p"), "codes")
    wanted = durable(members.select(F.col("doc_id").alias("p")).distinct().join(codes, "p"))
    texts = durable(base.join(few(wanted), F.col("doc_id") == F.col("p")).select("doc_id", "text", "codes"))
    tested = members.where("doc_id <> leader").select("leader", F.col("doc_id").alias("member")).distinct()
    links = durable(_verified(durable(tested), texts, threshold, kind))
    linked = components(links, "leader", "member")
    # a bucket of two has met; larger ones may hold components that their leader did not connect
    apart = durable(meetings(members.where("n > 2").select("bucket", F.col("doc_id").alias("node")), linked))
    if not apart.isEmpty():
        across = _across(apart, texts, threshold, kind).dropDuplicates(["leader", "member"])
        links = durable(links.unionAll(across.join(links, ["leader", "member"], "left_anti")))
        linked = components(links, "leader", "member")

    degree = links.select(F.col("leader").alias("d")).unionAll(links.select(F.col("member").alias("d"))).groupBy("d").agg(F.count(F.lit(1)).alias("links"))
    classes = reps.join(linked, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("class_id"), "copies")
    sizes = classes.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    return (
        profile.select("doc_id", "key")
        .join(classes.join(sizes, "class_id").select("key", "class_id", "class_size"), "key")
        .join(degree, F.col("doc_id") == F.col("d"), "left")
        .select("doc_id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"), (F.col("doc_id") == F.col("class_id")).alias("kept"))
    )


def _profiles(base: DataFrame, n: int, size: int, bands: int, rows: int, kind: str) -> DataFrame:
    """(doc_id, key, bands, codes): the idf of each document's shingles in order, and what follows from it."""
    groups = groups_for(size, GROUP)
    ranges = 1 << (groups_for(size * 2, RANGE) - 1).bit_length()
    dealt = base.withColumn("g", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(groups)).cast("int"))
    return durable(dealt.groupBy("g").cogroup(_codes(dealt, n, ranges).groupBy("g")).applyInArrow(_profile(bands, rows), f"doc_id {kind}, key binary, bands array<bigint>, codes binary"))


def _across(apart: DataFrame, texts: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(leader, member, similarity): links at the threshold that connect the components of each
    bucket. A product of matrices over the shingles that two members have finds the candidates,
    similarity() decides."""
    dealt = apart.join(texts.withColumnRenamed("doc_id", "node"), "node")

    def run(key, t):
        turn("near_dedup")
        t = t.sort_by("node").combine_chunks()
        ids = t.column("node")
        vectors = _weighted(t.column("text").chunk(0), t.column("codes").chunk(0))
        total = np.array([w.sum() for _, w in vectors])
        # the root of the product bounds the minimum from above, so no pair is lost
        common = products([(h, np.sqrt(w)) for h, w in vectors])
        likely = common * (1 + threshold) >= threshold * (total[:, None] + total) * (1 - 1e-4)
        how = {}

        def sure(j, i):
            how[j, i] = similarity(vectors[j], vectors[i])
            return how[j, i] >= threshold

        found = Forest(t.column("component").to_pylist()).links(likely, sure)
        first, second = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
        return pa.table({"leader": ids.take(first), "member": ids.take(second), "similarity": pa.array([how[p] for p in found], pa.float64())})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(run, f"leader {kind}, member {kind}, similarity double")


def _unique_texts(t: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Ids and texts in a fixed order, the last text of an id."""
    t = t.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids, texts = (t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0) for c in ("doc_id", "text"))
    if len(ids) > 1:
        last = np.asarray(pa.compute.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)))
        if not last.all():
            keep = pa.array(np.concatenate([last, [True]]))
            ids, texts = ids.filter(keep), texts.filter(keep)
    return ids, texts


def _codes(dealt: DataFrame, n: int, ranges: int) -> DataFrame:
    """(g, part, codes): the idf of a group's distinct shingles, in order of their hashes."""

    # range p holds the hashes whose first `bits` bits are p; the next 48 bits are sent, byte by
    # byte, as the first bytes of sorted numbers repeat
    bits = ranges.bit_length() - 1

    def pack(h):
        rest = (h << np.uint64(bits)).astype(">u8")
        return _binary(rest.view(np.uint8).reshape(len(h), 8)[:, :6].T)

    def unpack(x):
        planes = np.frombuffer(x.as_buffer(), np.uint8).reshape(6, -1)
        out = np.zeros((planes.shape[1], 8), np.uint8)
        out[:, :6] = planes.T
        return out.view(">u8").ravel().astype(np.uint64)

    def send(key, t):
        turn("near_dedup")
        _, h, _, _ = _vectors(_unique_texts(t)[1])
        at = _runs(h)
        h, df = h[at], np.diff(np.concatenate([at, [len(h)]]))
        cut = np.searchsorted(h, np.arange(ranges, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64))
        cut = np.concatenate([cut, [len(h)]])
        filled = [p for p in range(ranges) if cut[p] < cut[p + 1]]
        return pa.table(
            {
                "g": pa.array([key[0].as_py()] * len(filled), pa.int32()),
                "part": pa.array(filled, pa.int32()),
                "hashes": pa.array([pack(h[cut[p] : cut[p + 1]]) for p in filled], pa.binary()),
                "df": pa.array([_binary(df[cut[p] : cut[p + 1]].astype(np.uint32)) if (df[cut[p] : cut[p + 1]] > 1).any() else b"" for p in filled], pa.binary()),
            }
        )

    def count(key, t):
        turn("near_dedup")
        sent = [unpack(x) for x in t.column("hashes")]
        df = [np.frombuffer(x.as_buffer(), np.uint32) if len(x.as_buffer()) else np.ones(len(h), np.uint32) for x, h in zip(t.column("df"), sent, strict=True)]
        h, df = np.concatenate(sent), np.concatenate(df)
        order = np.argsort(h, kind="stable")
        at = _runs(h[order])
        total = np.add.reduceat(df[order].astype(np.int64), at)
        codes = np.empty(len(h), np.uint8)
        codes[order] = np.repeat(idf_codes(total, n), np.diff(np.concatenate([at, [len(h)]])))
        ends = np.cumsum([len(x) for x in sent])
        return pa.table({"g": t.column("g"), "part": t.column("part"), "codes": pa.array([_binary(x) for x in np.split(codes, ends[:-1])], pa.binary())})

    sent = dealt.groupBy("g").applyInArrow(send, "g int, part int, hashes binary, df binary")
    return sent.groupBy("part").applyInArrow(count, "g int, part int, codes binary")


def _profile(bands: int, rows: int):
    def run(key, left, right):
        turn("near_dedup")
        ids, texts = _unique_texts(left)
        text, h, tf, words = _vectors(texts)
        right = right.combine_chunks().sort_by("part")
        idf = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in right.column("codes"))])
        at = _runs(h)
        code = np.repeat(idf, np.diff(np.concatenate([at, [len(h)]])))
        order = np.argsort(text, kind="stable")
        text, h, tf, code = text[order], h[order], tf[order], code[order]
        starts = _runs(text)
        names, codes = np.full((len(ids), bands), -1, np.int64), [b""] * len(ids)
        if len(h):
            drawn = samples(h, tf * (1 + code / 255.0), starts, bands * rows)
            for b in range(bands):
                total = np.full(len(starts), b + 1, np.uint64)
                for k in range(b * rows, (b + 1) * rows):
                    total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + drawn[k])
                names[text[starts], b] = total.view(np.int64)
            for t, x in zip(text[starts].tolist(), np.split(code, starts[1:]), strict=True):
                codes[t] = _binary(x)
        return pa.table(
            {
                "doc_id": ids,
                "key": pa.array([_binary(k) for k in words], pa.binary()),
                "bands": pa.ListArray.from_arrays(np.arange(0, len(ids) * bands + 1, bands, dtype=np.int32), pa.array(names.ravel())),
                "codes": pa.array(codes, pa.binary()),
            }
        )

    return run


def _weighted(texts: pa.Array, codes: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles in order, weights) of each text."""
    text, h, tf, _ = _vectors(texts)
    order = np.argsort(text, kind="stable")
    text, h, tf = text[order], h[order], tf[order]
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(h[at[i] : at[i + 1]], tf[at[i] : at[i + 1]] * (1 + np.frombuffer(codes[i].as_buffer(), np.uint8) / 255.0)) for i in range(len(texts))]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of minima over the sum of maxima; two empty sets are alike."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 1.0
    at = np.minimum(np.searchsorted(a[0], b[0]), max(0, len(a[0]) - 1))
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    common = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(common / (total - common))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(leader, member, similarity) of the pairs at the threshold, from whole texts.

    A leader with many members is dealt to one task for each FAN of them; only its own text is
    repeated. Members arrive in slices, so that no group is held at once.
    """
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("member"), F.lit(1 << 20)))
    fan = pairs.groupBy(F.col("leader").alias("l")).agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("int").alias("salts"))
    salted = salted.join(fan, F.col("leader") == F.col("l")).select("leader", "member", (F.col("s") % F.col("salts")).cast("int").alias("salt"))
    led = texts.join(fan, F.col("doc_id") == F.col("l")).select(
        F.col("doc_id").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast(kind).alias("member"), "text", "codes"
    )
    each = texts.join(salted, F.col("doc_id") == F.col("member")).select("leader", "salt", "member", "text", "codes")

    def run(key, t):
        turn("near_dedup")
        member = t.column("member").combine_chunks()
        lead = int(np.flatnonzero(np.asarray(member.is_null()))[0])
        rows = t.combine_chunks()
        text, code = rows.column("text").chunk(0), rows.column("codes").chunk(0)
        head = _weighted(text.slice(lead, 1), code.slice(lead, 1))[0]
        who, how = [], []
        for low, high in parts(text):
            for i, v in enumerate(_weighted(text.slice(low, high - low), code.slice(low, high - low)), low):
                if i != lead and member[i].is_valid and (s := similarity(head, v)) >= threshold:
                    who.append(i)
                    how.append(s)
        return pa.table({"leader": rows.column("leader").take(pa.array(who, pa.int64())), "member": member.take(pa.array(who, pa.int64())), "similarity": pa.array(how, pa.float64())})

    return led.unionByName(each).groupBy("leader", "salt").applyInArrow(run, f"leader {kind}, member {kind}, similarity double")
