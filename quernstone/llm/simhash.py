"""SimHash fingerprints and near-duplicate groups by tiled exact comparison; near copies by the Jaccard likeness of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StructType

from quernstone.llm.common import attach, batches_of, cut, give_back, having, without
from quernstone.llm.components import components

WORDS = 4
RADIUS = 4
SEED = 42
#: Rows of a bucket that are compared in one task; larger buckets are split into pairs of tiles.
TILE = 32_768
#: Near copies: texts whose sets of shingles of so many words have at least this Jaccard likeness.
COPY_WORDS = 5
COPY_JACCARD = 0.8
#: Texts meet if they agree in all least hashes of a band. At a likeness of 0.8 a pair misses all 20 bands of 4 with a chance of 3 in 100,000, above it with less.
BANDS, BAND = 20, 4
#: Rows and bytes of text of a bucket that are compared in one task; larger buckets are split into pairs of tiles.
COPY_TILE, COPY_BYTES = 4096, 6 << 20
_BLOCK = 1 << 16
#: Rows with texts that a Python worker gets at once.
ROWS_AT_ONCE = 1000


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles in order; a text of fewer words is one shingle, null or no words none.

    Words are found in the text's bytes as a whole and shingles hashed block by block, so a very long text takes little more memory than its bytes.
    """
    data = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes.lower() changes A-Z only
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]  # one space after each word
    kept = np.where(space, 32, data)[keep] if len(data) else data
    kept = kept[: len(kept) - 1] if len(kept) and kept[-1] == 32 else kept
    kept = kept[1:] if len(kept) and kept[0] == 32 else kept
    if not len(kept):
        return np.zeros(0, "<u8")
    line, gaps = kept.astype(np.uint8).tobytes(), np.flatnonzero(kept == 32)
    n = max(1, len(gaps) + 2 - words)
    out, of = np.empty(n, "<u8"), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        many = min(_BLOCK, n - at)
        starts = (gaps[at - 1 : at - 1 + many] + 1 if at else np.concatenate(([0], gaps[: many - 1] + 1))).tolist()
        stops = gaps[at + words - 1 : at + words - 1 + many].tolist()
        stops += [len(line)] * (many - len(stops))
        out[at : at + many] = [of(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)]
    return out


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for null or no words."""
    return _simhash(shingles(text, words))


def _simhash(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))


def masks(count: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that two fingerprints within radius agree under at least one of them.

    The bits are cut into blocks of which radius can touch only radius, so some whole blocks agree. More blocks and more masks
    are used as the fingerprints grow in number, to keep buckets small; any choice finds the same pairs.
    """
    agree = 1 if count < 1 << 24 else 2 if count < 1 << 32 else 3
    edges = np.linspace(0, 64, radius + agree + 1).astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _forest(group: np.ndarray, pop: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within radius inside each group, as a spanning forest (root, member); rows are sorted by group and popcount."""
    n = len(fp)
    root = np.arange(n)
    left, step = np.arange(n), 0
    while len(left):
        step += 1
        left = left[left + step < n]
        right = left + step
        left = left[(group[left] == group[right]) & (pop[right] - pop[left] <= radius)]  # later ones are farther still
        right = left + step
        near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
        a, b = left[near], right[near]
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    member = np.flatnonzero(root != np.arange(n))
    return root[member], member


def _compare(frames: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """Links of the complete groups of a partition sorted by (group, pop); a group at a batch's end waits for the next batch."""
    rest: pd.DataFrame | None = None

    def links(x: pd.DataFrame) -> pd.DataFrame:
        ids = x["id"].to_numpy()
        a, b = _forest(x["grp"].to_numpy(), x["pop"].to_numpy().astype(np.int64), x["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    for x in frames:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        whole = int(np.searchsorted(x["grp"].to_numpy(), x["grp"].iloc[-1])) if len(x) else 0
        if whole:
            yield links(x.iloc[:whole])
        rest = x.iloc[whole:]
    if rest is not None and len(rest):
        yield links(rest)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of ids that span the same components as all pairs of fingerprints within radius. fps: fp, id, distinct fp, checkpointed."""
    count = fps.count()
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(count, radius))])).alias("t")
    keyed = fps.select("id", "fp", F.bit_count("fp").alias("pop"), table).select("id", "fp", "pop", "t.k", "t.key")
    large = cut(keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    whole = keyed.withColumn("pair", F.lit("").cast("string"))
    if large.count():
        whole = keyed.join(large.select("k", "key"), ["k", "key"], "left_anti").withColumn("pair", F.lit(""))
        # A large bucket: a tile is a popcount band and a hashed part; bands further apart than radius never meet.
        split = keyed.join(large, ["k", "key"]).withColumn("parts", F.ceil(F.col("n") / (TILE // 2)).cast("int"))
        band = (F.col("pop") / (radius + 1)).cast("int")
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        tile = band * F.col("parts") + part
        others = F.sequence(F.greatest(band - 1, F.lit(0)) * F.col("parts"), (band + 2) * F.col("parts") - 1)
        pair = F.explode(F.transform(others, lambda o: F.concat_ws("-", F.least(o, tile), F.greatest(o, tile)))).alias("pair")
        whole = whole.unionByName(split.select("id", "fp", "pop", "k", "key", pair))
    groups = whole.select("id", "fp", F.col("pop").cast("int").alias("pop"), F.xxhash64("k", "key", "pair").alias("grp"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(n, "grp").sortWithinPartitions("grp", "pop")
    return dealt.mapInPandas(lambda frames: _compare(frames, radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, the smallest id reachable by links.

    Two documents link if their fingerprints differ in at most radius bits. Equal fingerprints are compared once. Null, empty
    and blank texts have fingerprint zero and link like others. Rows with a null id get a fingerprint and, as they cannot
    name a group, a component only if another row of their group has an id. A repeated id does not tie unlike fingerprints
    together. Repeated rows are reported each time.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    by_fp = cut(rows.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    parts = components(cut(fingerprint_links(by_fp.select("fp", F.col("fp").alias("id")), radius)))
    linked = cut(by_fp.join(parts.withColumnRenamed("node", "fp"), "fp"))
    least = cut(linked.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("size")))
    linked = attach(linked, least, ["component"], "size", linked.count()).select("fp", "component_id", "n")
    alone = by_fp.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("id").alias("component_id"), "n")
    of_fp = cut(linked.unionByName(alone))
    found = attach(rows, of_fp, ["fp"], "n", rows.count())
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _set_of(hashes: np.ndarray) -> np.ndarray:
    """The distinct ones of a text's shingles; blank texts have one in common."""
    found = np.unique(hashes)
    return found if len(found) else np.zeros(1, "<u8")


def _shingle_set(text: str | None) -> np.ndarray:
    return _set_of(shingles(text, COPY_WORDS))


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND, 1), np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def band_keys(found: np.ndarray) -> np.ndarray:
    """For each band a hash of the band's place and of the least hashes of a set of shingles."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[None, at : at + 1024] * _TIMES + _PLUS).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _FOLD
    for row in least.reshape(BANDS, BAND).T:
        key = (key ^ row) * _FOLD
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


@pandas_udf(StructType().add("fp", LongType()).add("keys", ArrayType(LongType())))
def copy_marks_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """fp, the SimHash of a text's shingles of COPY_WORDS words, and keys, its band_keys."""
    for text in batches:
        fps, keys = np.empty(len(text), np.uint64), []
        for i, t in enumerate(text):
            hashes = shingles(t, COPY_WORDS)
            fps[i] = _simhash(hashes)
            keys.append(band_keys(_set_of(hashes)))
        yield pd.DataFrame({"fp": fps.view(np.int64), "keys": keys})
    give_back()


def _copies(texts: list[str | None], linked: list[int]) -> list[tuple[int, int]]:
    """Links (place, place) that, beside those there are (texts with one number in linked), span the same components as all pairs of texts whose shingles have Jaccard likeness COPY_JACCARD or more."""
    sets = [_shingle_set(t) for t in texts]
    size = np.array([len(x) for x in sets])
    names, held = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)]
    root = np.unique(np.array(linked), return_inverse=True)[1]
    mark = np.zeros(len(names), bool)
    out = []
    for i in range(len(sets) - 1):
        least, most = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        rest = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (least >= COPY_JACCARD * most))
        if not len(rest):
            continue
        mine = held[starts[i] : starts[i + 1]]
        mark[mine] = True
        of = np.repeat(starts[rest] - np.r_[0, np.cumsum(size[rest])[:-1]], size[rest]) + np.arange(size[rest].sum())
        both = np.add.reduceat(mark[held[of]].astype(np.int64), np.r_[0, np.cumsum(size[rest])[:-1]])
        mark[mine] = False
        for j in rest[both >= COPY_JACCARD * (size[i] + size[rest] - both)].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _compare_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the groups of a partition sorted by grp; a group at a batch's end waits for the next batch."""
    rest: pd.DataFrame | None = None

    def links(x: pd.DataFrame) -> pd.DataFrame:
        grp, nodes, texts, linked = x["grp"].to_numpy(), x["node"].to_numpy(), x["text"].tolist(), x["component"].tolist()
        edges = np.r_[0, np.flatnonzero(grp[1:] != grp[:-1]) + 1, len(grp)].tolist()
        found = [(a + i, a + j) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1 for i, j in _copies(texts[a:b], linked[a:b])]
        at = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": nodes[at[:, 0]], "b": nodes[at[:, 1]]})

    for x in frames:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        whole = int(np.searchsorted(x["grp"].to_numpy(), x["grp"].iloc[-1])) if len(x) else 0
        if whole:
            yield links(x.iloc[:whole])
        rest = x.iloc[whole:].copy() if whole else x
    if rest is not None and len(rest):
        yield links(rest)
    give_back()


def copy_links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that span the components of near copies. nodes: node, bytes, keys, component, checkpointed, each node once; texts: node, text.

    Nodes of one component are linked already; only buckets of more than one component are compared. Buckets with the same members are compared once. Pairs are
    confirmed by the exact likeness of their texts; only texts of such buckets are shuffled.
    """
    keyed = nodes.select("node", "bytes", "component", F.explode("keys").alias("key"))
    members = F.bit_xor(F.xxhash64("node")).alias("members")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), members, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    parts = F.greatest(F.ceil(F.col("n") / (COPY_TILE // 2)), F.ceil(F.col("size") / (COPY_BYTES // 2))).cast("int")
    tiles = F.when((F.col("n") <= COPY_TILE) & (F.col("size") <= COPY_BYTES), 1).otherwise(parts).alias("tiles")
    buckets = cut(buckets.groupBy("n", "size", "members").agg(F.min("key").alias("key")).select("key", tiles))
    part = F.pmod(F.xxhash64("node", "key"), F.col("tiles")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: (o != part) | (F.col("tiles") == 1))
    pair = F.explode(F.transform(others, lambda o: F.concat_ws("-", F.least(o, part), F.greatest(o, part)))).alias("pair")
    met = cut(keyed.join(buckets, "key").select("node", "component", "key", pair).select("node", "component", F.xxhash64("key", "pair").alias("grp")))
    wanted = having(texts, met.select("node").distinct(), "node").dropDuplicates(["node"])
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.join(wanted, "node").select("grp", "node", "component", "text").repartition(n, "grp").sortWithinPartitions("grp")
    return dealt.mapInPandas(_compare_texts, "a long, b long")


def simhash_groups(nodes: DataFrame, total: int, radius: int = RADIUS) -> DataFrame:
    """nodes (of about that many rows, with fp; checkpointed) with near: the least fingerprint reachable over fingerprints that differ in at most radius bits, null for nodes that meet no other."""
    by_fp = cut(nodes.groupBy("fp").agg(F.count("*").alias("size")))
    parts = components(cut(fingerprint_links(by_fp.select("fp", F.col("fp").alias("id")), radius)))
    met = by_fp.join(parts.withColumnRenamed("node", "fp"), "fp", "left").where("component is not null or size > 1")
    return attach(nodes, cut(met.select("fp", F.coalesce("component", "fp").alias("near"), "size")), ["fp"], "size", total).drop("size")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, the one of smallest id; all columns stay, whatever their names.

    Groups come from SimHash fingerprints first, as in near_groups: those within RADIUS bits meet in tiles pruned by popcount, components are contracted, and the exact likeness of texts
    confirms the links within a component. RADIUS holds few of the pairs that are barely alike (9 to 10 bits of 64 at a likeness of 0.8), so texts that are not linked yet meet again where a band of their least hashes agrees.
    Two documents link if the sets of their shingles of COPY_WORDS words have a Jaccard likeness of COPY_JACCARD or more; equal texts link, and blank
    texts (null, empty, white space) do with each other. A row is known by its id and its text: a null or repeated id does not tie unlike texts together, and a null id
    stays only in a group without other ids. Texts are known by a 64-bit hash while they are compared; texts that share one by chance are told apart by SHA-256, and stay. Of rows with one id and one text one stays. Whole texts are compared. An empty table gives an empty result.
    """
    node, sure = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    length = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    with batches_of(docs.sparkSession, ROWS_AT_ONCE):
        rows = cut(docs.select(F.col(id_col).alias("id"), node.alias("node"), length.alias("bytes"), sure.alias("sure"), copy_marks_udf(F.col(text_col)).alias("marks")))
    one = F.min("sure") == F.max("sure")  # else unlike texts share a hash: none of them is compared or dropped
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.first("marks").alias("marks"), one.alias("one"))
    nodes = cut(nodes.where("one").select("node", "id", "n", "bytes", "marks.*"))
    total, texts = rows.count(), docs.select(node.alias("node"), F.col(text_col).alias("text"))
    near = simhash_groups(nodes.select("node", "bytes", "fp"), total).where("near is not null")
    with batches_of(docs.sparkSession, ROWS_AT_ONCE):
        links = cut(copy_links(texts, cut(near.select("node", "bytes", F.array("near").alias("keys"), F.col("node").alias("component")))))
    parts = cut(components(links))
    left = nodes.join(parts, "node", "left").select("node", "bytes", F.slice("keys", 1, BANDS).alias("keys"), F.coalesce("component", "node").alias("component"))
    with batches_of(docs.sparkSession, ROWS_AT_ONCE):
        links = links.unionByName(cut(copy_links(texts, cut(left))))
    parts = cut(components(links))
    of_node = nodes.select("node", "id", "n").join(parts, "node", "left").where("component is not null or n > 1")
    of_node = cut(of_node.withColumn("component", F.coalesce("component", "node")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    kept = cut(of_node.groupBy("component").agg(first, F.count("*").alias("size")))
    of_node = cut(attach(of_node, kept, ["component"], "size", of_node.count()).select("node", "n", F.col("first.id").alias("keep_id"), F.col("first.node").alias("keep_node")))
    found = attach(rows.select("id", "node"), of_node, ["node"], "n", total).where("keep_node is not null")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node"))
    found = cut(found.select(F.col("id").alias("key_id"), F.col("node").alias("key_text"), stays.alias("stays")).groupBy("key_id", "key_text").agg(F.first("stays").alias("stays"), F.count("*").alias("n")))
    return without(docs, found.where("not stays"), found.where("stays and n > 1"), {"key_id": F.col(id_col), "key_text": node})
