"""Exact Jaccard self-join of documents on word shingles by a token-group matrix.

A document's set holds its distinct shingles. Two documents link when the
overlap reaches a share t of the union; then it reaches t of either set too.
That bound is used at two levels:

1. All other documents as one group. A shingle that no other text has cannot
   add to any overlap, so a text whose shared shingles cover less than t of its
   set has no link. Tasks send each distinct shingle once, as a packed hash; the
   answer says which ones occur elsewhere. Most texts end here.
2. Groups of similar texts. The rest get groups by minimum hashes. Texts that
   link with the leader of a group form verified clusters, and a cluster needs
   no more comparison inside. The matrix has a row for each token and group
   (clusters and groups cut into slices of bounded size); tokens that only one
   cluster has are left out, rare ones come first, and a query looks up the
   prefix of its tokens that any link must touch. These prefixes select the
   groups. When a group is opened, a query whose overlap with its token union is
   below t is passed over, and members are compared exactly.

Links found join the clusters to components. No step lists all pairs of a group
of similar texts: for the components, members of a cluster are never paired
again. Where the number of links is asked for, members of a cluster are compared
slice by slice and each task gives a count for each of its queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import planned_bytes, ready, slices_of, stored, table, tidy, whole_text
from matchflow.llm.components import components

#: Words of a shingle, and the least Jaccard similarity of a link in percent.
WIDTH, PERCENT = 5, 75
#: Minimum hashes that propose groups; more find more links early, none are lost with fewer.
KEYS = 4
#: Texts of a proposed group that all of its texts are compared with.
LEADERS = 3
#: Members and shingles of a slice of a group, queries of a unit of comparison.
GROUP_MEMBERS, GROUP_TOKENS, UNIT_QUERIES = 256, 200_000, 64
#: Characters of the documents that a task packs together.
CHUNK_CHARS = 4_000_000
#: Distinct words whose hash a task remembers.
MEMORY_WORDS = 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, packed."""
    return _pack(np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8).T).tobytes())


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(data), "u1").reshape(8, -1).T).view("<u8").reshape(-1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads its input."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """Words of the text, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACES).split(b" ")


class Shingler:
    """Distinct shingles of texts as sorted hashes."""

    def __init__(self, width: int = WIDTH):
        self.width, self.hashes = width, _Hashes()

    def words(self, text: str) -> list[bytes]:
        return [w for w in words_of(text) if w]

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        values = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        rows = len(words) - width + 1
        out = np.full(rows, width, np.uint64)
        for i in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[i:i + rows])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def key_of(words: list[bytes]) -> bytes:
    """Equal for texts of equal words."""
    return hashlib.md5(b" ".join(words)).digest()


_DEALT = "slice long, chunk long, first binary, second binary"


def _row(part: int, chunk: int, first: bytes, second: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "slice": pa.array([part], pa.int64()), "chunk": pa.array([chunk], pa.int64()),
        "first": pa.array([first], pa.binary()), "second": pa.array([second], pa.binary()),
    })


def _dealer(slices: int, bits: int, width: int):
    """Documents in; a row of documents per chunk (its slice is negative), and its distinct shingles by slice.

    A shingle goes on once per chunk. If one document of the chunk alone has it,
    the document's number goes with it; otherwise it counts as shared already.
    """

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shingler = TaskContext.get().partitionId(), Shingler(width)
        held, chars = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            keys = [k for _, _, k, _ in held]
            first = {}  # equal texts of a chunk are one
            for i, k in enumerate(keys):
                first.setdefault(k, i)
            own = sorted(first.values())
            sizes = np.array([len(s) for _, _, _, s in held])
            hashes = np.concatenate([held[i][3] for i in own])
            numbers = np.repeat(np.array(own), sizes[own])
            order = np.argsort(hashes, kind="stable")
            hashes, numbers = hashes[order], numbers[order]
            fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
            alone = fresh & np.concatenate([fresh[1:], [True]]) if len(hashes) else fresh
            shared = np.bincount(numbers[~alone], minlength=len(held))
            shared = shared[[first[k] for k in keys]]
            chunk = int.from_bytes(hashlib.md5(b"%d" % part + b"".join(keys)).digest()[:8], "little", signed=True)
            documents = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d for d, _, _, _ in held], pa.int64()), "raw": pa.array([r for _, r, _, _ in held], pa.binary()),
                "key": pa.array(keys, pa.binary()), "same": pa.array([first[k] for k in keys], pa.int64()),
                "n": pa.array(sizes, pa.int64()), "shared": pa.array(shared, pa.int64()),
            })
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, documents.schema) as out:
                out.write_batch(documents)
            yield _row(-1 - chunk % slices, chunk, _pack(sink.getvalue().to_pybytes()), b"")
            entry, who = hashes[fresh], np.where(alone, numbers + 1, 0)[fresh]
            to = ((entry >> np.uint64(32)) % np.uint64(slices)).astype("i8")
            value = mixed(entry) & np.uint64((1 << bits) - 1)
            order = np.lexsort((value, to))
            to, value, who = to[order], value[order], who[order]
            edges = np.searchsorted(to, np.arange(slices + 1))
            for s in range(slices):
                a, b = edges[s], edges[s + 1]
                if a < b:
                    yield _row(s, chunk, _planes(np.diff(value[a:b], prepend=np.uint64(0))), _planes(who[a:b]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and chars + len(text) > CHUNK_CHARS:
                    yield from rows()
                    held, chars = [], 0
                words = shingler.words(text)
                raw = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                held.append((doc, raw, key_of(words), shingler.shingles(words)))
                chars += len(text)
        if held:
            yield from rows()

    return deal


def _match(key: tuple, rows: pa.Table) -> pa.Table:
    """Entries of a slice in, for each chunk the numbers of documents whose shingles other chunks have too."""
    part = key[0].as_py()
    if part < 0:
        return rows
    chunks = rows.column("chunk").to_pylist()
    values = [np.cumsum(_unplanes(b), dtype=np.uint64) for b in rows.column("first").to_pylist()]
    whos = [_unplanes(b).astype("i8") for b in rows.column("second").to_pylist()]
    source = np.repeat(np.arange(len(chunks)), [len(v) for v in values])
    value, who = np.concatenate(values), np.concatenate(whos)
    del values, whos
    order = np.argsort(value, kind="stable")
    value, who, source = value[order], who[order], source[order]
    same = value[1:] == value[:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    hit = twice & (who > 0)
    who, source = who[hit], source[hit]
    order = np.argsort(source, kind="stable")
    who, source = who[order], source[order]
    edges = np.searchsorted(source, np.arange(len(chunks) + 1))
    out = [(c, _planes(np.sort(who[a:b]) - 1)) for c, a, b in zip(chunks, edges[:-1], edges[1:]) if a < b]
    return pa.table({
        "slice": pa.array([part] * len(out), pa.int64()), "chunk": pa.array([c for c, _ in out], pa.int64()),
        "first": pa.array([b"" for _ in out], pa.binary()), "second": pa.array([b for _, b in out], pa.binary()),
    })


def _cover(key: tuple, rows: pa.Table) -> pa.Table:
    """Rows of a chunk in, its documents with the number of their shared shingles out."""
    documents, counts = [], []
    for part, first, second in zip(*(rows.column(c).to_pylist() for c in ("slice", "first", "second"))):
        if part < 0:
            documents.append(pa.ipc.open_stream(_unpack(first)).read_all())
        else:
            counts.append(_unplanes(second).astype("i8"))
    if len(documents) != 1:
        raise RuntimeError("the input changed between two attempts of a task; store it first")
    own = documents[0]
    more = np.bincount(np.concatenate([np.zeros(0, "i8"), *counts]), minlength=own.num_rows)
    shared = own.column("shared").to_numpy() + more[own.column("same").to_numpy()]
    return own.drop_columns(["same", "shared"]).append_column("shared", pa.array(shared, pa.int64()))


def covered(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, raw (MD5 of the text), key (MD5 of its words), n (distinct shingles) and shared: how many of
    them other texts have too, at most (hashes are cut, so a few may count that no other text has)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    slices = slices_of(rows)
    bits = min(62, max(16, (planned_bytes(rows) // slices + 1).bit_length() + 6))
    dealt = rows.mapInArrow(_dealer(slices, bits, width), _DEALT)
    answers = dealt.groupBy("slice").applyInArrow(_match, _DEALT)
    return answers.groupBy("chunk").applyInArrow(_cover, "doc_id long, raw binary, key binary, n long, shared long")


def _node_maker(width: int, keys: int):
    seeds = mixed(np.arange(1, keys + 1, dtype=np.uint64))

    @tidy
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = shingler.words(text)
                if key_of(words) != key:
                    continue
                tokens = shingler.shingles(words)
                lows = [int(mixed(tokens ^ s).min().astype("i8")) for s in seeds]
                out.append((key, len(tokens), tokens.astype("<u8").tobytes(), lows))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([o[0] for o in out], pa.binary()), "n": pa.array([o[1] for o in out], pa.int64()),
                "tokens": pa.array([o[2] for o in out], pa.binary()), "lows": pa.array([o[3] for o in out], pa.list_(pa.int64())),
            })

    return make


def linked(overlap, n, m, percent: int):
    """Whether the overlap of sets of n and m elements reaches the share of the union."""
    return 100 * overlap >= percent * (n + m - overlap)


def _pair_checker(percent: int):
    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                good.append(bool(linked(int((y[at] == x).sum()), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return check


def _opener(percent: int):
    """Groups and queries in, links between their clusters out: a spanning set of those that hold."""

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, queries in zip(batch.column("members"), batch.column("queries")):
                links = sorted(set(open_group(members.as_py(), queries.as_py(), percent)))
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return search


def open_group(members: list[dict], queries: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of clusters that a link joins."""
    sets = [np.frombuffer(m["tokens"], "<u8") for m in members]
    sizes = np.array([len(s) for s in sets])
    clusters = np.array([m["cluster"] for m in members])
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for query in queries:
        own = np.frombuffer(query["tokens"], "<u8")
        left, right = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
        width = right - left
        if 100 * int((width > 0).sum()) < percent * len(own):  # the bound by the group's union
            continue
        ends = np.cumsum(width)
        hits = owner[np.arange(int(ends[-1])) - np.repeat(ends - width - left, width)]
        overlap = np.bincount(hits, minlength=len(sets))
        good = linked(overlap, len(own), sizes, percent) & (clusters != query["cluster"])
        for cluster in np.unique(clusters[good]).tolist():
            a, b = find(cluster), find(query["cluster"])
            if a != b:  # what earlier links of this unit join already needs no link more
                root[max(a, b)] = min(a, b)
                yield min(cluster, query["cluster"]), max(cluster, query["cluster"])


def count_group(members: list[dict], queries: list[dict], percent: int, inside: bool) -> Iterator[tuple[int, int]]:
    """Each query's id and how many documents of the members link with it: in its own cluster, but itself, or in others."""
    sets = [np.frombuffer(m["tokens"], "<u8") for m in members]
    sizes = np.array([len(s) for s in sets])
    clusters, ids, copies = (np.array([m[c] for m in members]) for c in ("cluster", "id", "copies"))
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for query in queries:
        own = np.frombuffer(query["tokens"], "<u8")
        left, right = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
        width = right - left
        if 100 * int((width > 0).sum()) < percent * len(own):
            continue
        ends = np.cumsum(width)
        hits = owner[np.arange(int(ends[-1])) - np.repeat(ends - width - left, width)]
        overlap = np.bincount(hits, minlength=len(sets))
        of = (clusters == query["cluster"]) & (ids != query["id"]) if inside else clusters != query["cluster"]
        count = int(copies[linked(overlap, len(own), sizes, percent) & of].sum())
        if count:
            yield query["id"], count


def _counter(percent: int):
    """Slices of a cluster in, each query's links within the cluster out."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, queries in zip(batch.column("members"), batch.column("queries")):
                rows = list(count_group(members.as_py(), queries.as_py(), percent, True))
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([i for i, _ in rows], pa.int64()), "n_links": pa.array([n for _, n in rows], pa.int64())})

    return count


def _opening_counter(percent: int):
    """As _opener, and each query's links with other clusters, from one pass: a and b, or id and n_links."""

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, queries in zip(batch.column("members"), batch.column("queries")):
                members, queries = members.as_py(), queries.as_py()
                links = sorted(set(open_group(members, queries, percent)))
                rows = list(count_group(members, queries, percent, False))
                none, more = [None] * len(links), [None] * len(rows)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([a for a, _ in links] + more, pa.int64()), "b": pa.array([b for _, b in links] + more, pa.int64()),
                    "id": pa.array(none + [i for i, _ in rows], pa.int64()),
                    "n_links": pa.array(none + [n for _, n in rows], pa.int64())})

    return search


def _clusters(nodes: DataFrame, percent: int) -> DataFrame:
    """Clusters by links with the leaders of groups: id, cluster (its smallest id)."""
    proposed = nodes.select("id", F.explode("lows").alias("low"))
    # Several leaders, so that a text which happens not to link with one of them rarely stays alone.
    first = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id"))["id"] for i in range(LEADERS)]
    leaders = proposed.groupBy("low").agg(F.array_distinct(F.array(*first)).alias("leaders"), F.count("*").alias("size"))
    pairs = proposed.join(leaders.filter("size > 1"), "low").select("id", F.explode("leaders").alias("leader")).filter(
        "id <> leader").select(F.greatest("id", "leader").alias("id"), F.least("id", "leader").alias("leader")).distinct()
    tokens = nodes.select("id", "tokens")
    both = pairs.join(tokens, "id").join(tokens.select(F.col("id").alias("leader"), F.col("tokens").alias("other")), "leader")
    links = both.select(F.col("id").alias("a"), F.col("leader").alias("b"), "tokens", "other").mapInArrow(
        _pair_checker(percent), "a long, b long")
    found = components(links)
    return nodes.select("id").join(found, nodes["id"] == found["node"], "left").select(
        "id", F.coalesce("label", "id").alias("cluster"))


def _openings(nodes: DataFrame, percent: int) -> DataFrame:
    """Groups as members, with the nodes that may link with one of another cluster as queries.

    ``nodes``: id, n, tokens, low, cluster, copies. Any two nodes meet in one group at most.
    """
    unpacked = nodes.mapInArrow(_unpacker, "id long, n long, cluster long, token long")
    crossing = unpacked.groupBy("token").agg(
        F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("count")
    ).filter("low <> high").select("token", "count")
    kept = unpacked.join(crossing, "token").groupBy("id", "n", "cluster").agg(
        F.sort_array(F.collect_list(F.struct("count", "token"))).alias("list"))
    need = F.ceil(F.col("n") * percent / F.lit(100))
    prefix = kept.filter(F.size("list") >= need).select(
        "id", "cluster", F.explode(F.slice("list", F.lit(1), (F.size("list") - need + 1).cast("int"))).alias("x")
    ).select("id", "cluster", F.col("x.token").alias("token"))
    prefix = stored(prefix, "prefixes")
    open_ids = prefix.select("id").distinct()

    # Groups: clusters, and single texts by their minimum hash, in slices of bounded size.
    alive = nodes.join(open_ids, "id")
    by = alive.groupBy("cluster").agg(F.count("*").alias("members"))
    home = alive.join(by, "cluster").select(
        "id", "n", "cluster", "copies", "tokens", F.when(F.col("members") > 1, F.col("cluster")).otherwise(F.col("low")).alias("home"),
        (F.col("members") > 1).alias("verified"))
    sizes = home.groupBy("verified", "home").agg(F.greatest(
        F.ceil(F.count("*") / GROUP_MEMBERS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("pieces"))
    home = home.join(sizes, ["verified", "home"]).select(
        "id", "n", "cluster", "copies", "tokens",
        F.xxhash64("verified", "home", F.pmod(F.xxhash64("id"), "pieces")).alias("group"))
    home = stored(home, "groups")
    place = home.select("id", "group")
    matrix = prefix.join(place, "id").select("token", "group").distinct()
    pure = home.groupBy("group").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    found = prefix.join(matrix, "token").select("id", "cluster", "group").distinct().join(pure, "group").filter(
        "low <> high or low <> cluster").select("id", "cluster", "group")
    found = stored(found, "candidates")
    units = found.groupBy("group").agg(F.ceil(F.count("*") / UNIT_QUERIES).alias("units"))
    asked = found.join(units, "group").withColumn("unit", F.pmod(F.xxhash64("id"), "units")).join(
        home.select("id", "tokens"), "id").groupBy("group", "unit").agg(
        F.collect_list(F.struct("id", "cluster", "tokens")).alias("queries"))
    groups = home.groupBy("group").agg(F.collect_list(F.struct("id", "cluster", "copies", "tokens")).alias("members"))
    return asked.join(groups, "group").select("members", "queries")


def _cluster_openings(nodes: DataFrame) -> DataFrame:
    """Each slice of a cluster as members, with each slice of it as queries."""
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("size"), F.greatest(
        F.ceil(F.count("*") / GROUP_MEMBERS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("pieces")).filter("size > 1")
    dealt = nodes.join(sizes, "cluster").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces"))
    row = F.struct("id", "cluster", "copies", "tokens")
    slices = stored(dealt.groupBy("cluster", "piece", "pieces").agg(F.collect_list(row).alias("members")), "slices")
    pairs = slices.select("cluster", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other"))
    queries = slices.select("cluster", F.col("piece").alias("other"), F.col("members").alias("queries"))
    # Numbers of slices are paired first; their rows come by a key that has few rows.
    return pairs.join(slices.select("cluster", "piece", "members"), ["cluster", "piece"]).join(
        queries, ["cluster", "other"]).select("members", "queries")


def _cross_links(nodes: DataFrame, percent: int) -> DataFrame:
    """Links between different clusters, as pairs of clusters: a, b."""
    return _openings(nodes, percent).mapInArrow(_opener(percent), "a long, b long")


def _counted_links(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """As _cross_links; and documents of other texts that each node links with: id, n_links, where there are any."""
    opened = stored(_openings(nodes, percent).mapInArrow(
        _opening_counter(percent), "a long, b long, id long, n_links long"), "opened")
    inside = _cluster_openings(nodes).mapInArrow(_counter(percent), "id long, n_links long")
    counts = inside.unionByName(opened.filter("id is not null").select("id", "n_links"))
    return opened.filter("a is not null").select("a", "b"), counts.groupBy("id").agg(F.sum("n_links").alias("n_links"))


@tidy
def _unpacker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, sizes, clusters = (batch.column(c).to_numpy() for c in ("id", "n", "cluster"))
        blob = b"".join(batch.column("tokens").to_pylist())
        yield pa.RecordBatch.from_pydict({
            "id": pa.array(np.repeat(numbers, sizes)), "n": pa.array(np.repeat(sizes, sizes)),
            "cluster": pa.array(np.repeat(clusters, sizes)), "token": pa.array(np.frombuffer(blob, "<i8"), pa.int64())})


def classes(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """One row per document: doc_id, raw (MD5 of the text), n_shingles, component_id; with ``links`` n_links too.

    Words are cut at white space, with A-Z in lower case; a text of fewer than
    ``width`` words has its whole sequence as its one shingle. Documents link
    when the Jaccard similarity of their sets is ``percent`` or more, and
    component_id is the smallest doc_id reachable by links, a document's own
    included. Null and empty texts have no shingles and no links. Equal texts
    are one node, so equal rows get equal results. A null doc_id is never the
    smallest; a component with no other id has a null component_id. Columns
    besides doc_id and text are ignored. No row is dropped.

    n_links is how many other rows a row links with, those of equal words
    included. All pairs within a component are compared for it, not listed.
    """
    spark = ready(documents.sparkSession)
    docs = stored(covered(documents, width), "covered")
    kinds = docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("shared").alias("shared"),
                                  F.count("*").alias("copies"))
    reach = docs.join(
        kinds.filter((F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n"))).select("key"), "key", "left_semi"
    ).groupBy("key").agg(F.min(F.struct("doc_id", "raw")).alias("r")).select("key", "r.doc_id", "r.raw")
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), whole_text("text").alias("text"))
    chosen = texts.join(reach, texts["id"].eqNullSafe(reach["doc_id"])).select("key", "text").mapInArrow(
        _node_maker(width, KEYS), "key binary, n long, tokens binary, lows array<long>")
    # A text that repeats under one id is one node.
    nodes = stored(chosen.withColumn("id", F.monotonically_increasing_id()), "nodes")
    repeated = nodes.groupBy("key").agg(F.min("id").alias("id"))
    names = nodes.select("key", F.col("id").alias("own")).join(repeated, "key").select("key", "id", "own")
    nodes = nodes.join(repeated.select("id"), "id", "left_semi")
    clusters = stored(_clusters(nodes, percent), "clusters")
    counted = None
    if clusters.limit(1).count():
        weights = nodes.select("id", "key").join(kinds.select("key", "copies"), "key").select("id", "copies")
        parts = nodes.select("id", "n", "tokens", F.col("lows")[0].alias("low")).join(clusters, "id").join(weights, "id")
        crossing, counted = _counted_links(parts, percent) if links else (_cross_links(parts, percent), None)
        merged = components(crossing)
        final = clusters.join(merged, clusters["cluster"] == merged["node"], "left").select(
            "id", F.coalesce("label", "cluster").alias("label"))
    else:
        final = clusters.select("id", F.col("cluster").alias("label"))
    of_key = names.select("key", "id").distinct().join(final, "id").join(kinds.select("key", "doc_id"), "key")
    lowest = of_key.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    reached = of_key.join(lowest, "label").select("key", "component_id", F.lit(True).alias("found"))
    known = kinds.join(reached, "key", "left").select(
        "key", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = ["doc_id", "raw", F.col("n").alias("n_shingles"),
           F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if links:
        others = nodes.select("key", "id").join(counted, "id").select("key", "n_links") if counted is not None else (
            nodes.select("key", F.lit(0).cast("long").alias("n_links")))
        known = known.join(others, "key", "left").join(kinds.select("key", "copies"), "key")
        out.append(F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
    return docs.join(known, "key").select(*out)


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents with one of each class of near copies: that with the smallest doc_id.

    All columns stay. Texts without words are classes of their own and stay. Of
    rows that repeat doc_id and text one stays; a class without any doc_id keeps
    one row of each of its texts.
    """
    kept = classes(documents).filter("doc_id <=> component_id")
    leaders = kept.groupBy(F.col("doc_id").alias("own_id"), F.col("raw").alias("own_raw")).agg(F.max("n_shingles").alias("n"))
    rows = documents.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.unhex(F.md5(F.encode(whole_text("text"), "utf-8"))).alias("raw"))
    both = rows.join(leaders, rows["id"].eqNullSafe(leaders["own_id"]) & (rows["raw"] == leaders["own_raw"]))
    single = both.filter("n > 0").dropDuplicates(["own_id", "own_raw"]).select("row.*")
    return single.unionByName(both.filter("n = 0").select("row.*"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op1_ngram_links(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


QUERIES = {"op1_ngram_join": op1_ngram_join, "op1_ngram_links": op1_ngram_links}
ORACLE = {
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS overlap
  FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o WHERE 100 * overlap >= 75 * (n + m - overlap)),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM g UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a
)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, min(r.reached) AS component_id
FROM g JOIN r USING (doc_id) GROUP BY g.doc_id, g.s
""",
    "op1_ngram_links": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS overlap
  FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o WHERE 100 * overlap >= 75 * (n + m - overlap)),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM g UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a
)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, min(r.reached) AS component_id,
  (SELECT count(*) FROM e WHERE e.a = g.doc_id) AS n_links
FROM g JOIN r USING (doc_id) GROUP BY g.doc_id, g.s
""",
}
