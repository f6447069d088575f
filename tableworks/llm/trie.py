"""Operator 11: the prefix trie of conversations, by ternary search trees over ranges of their turns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, read, released, stored
from .registry import query

#: Turns of one segment; a longer conversation continues in the next slab. Segments are the keys of the range exchange.
SLAB = 64
#: Turns put into trees together; bounds the memory of a task.
CHUNK = 100_000
#: Bytes of a turn's digest and of a node's key.
WIDTH = 16
ROOT = bytes(WIDTH)
FAMILY, HEAD = 20, 4
EMPTY = hashlib.sha256().hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(whole, 1, 2 * WIDTH)).alias("digest"), words.cast("long").alias("words")
    )


def _key(above: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(above + digest, digest_size=WIDTH).digest()


SEGMENT = "conv_id long, slab int, prefix binary, ids binary, words binary, last boolean, end_key binary"


def _segments(batches):
    """Sorted turns (donor's first) to segments: the key of the node where one begins, its turns' digests and words."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    conv, own, state = None, False, None

    def row(last):
        slab, prefix, ids, words, key = state
        return (conv, slab, prefix, b"".join(ids), np.array(words, "<i8").tobytes(), last, key if last else None)

    def table(rows):
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        rows = []
        for c, kind, skip, digest, words in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if c != conv:
                if own:
                    rows.append(row(True))
                conv, own, skipped, state = c, False, 0, (0, ROOT, [], [], ROOT)
            if kind:
                own = True
                if skipped < skip:
                    skipped += 1
                    continue
            slab, prefix, ids, counts, key = state
            if len(ids) == SLAB:
                rows.append(row(False))
                slab, prefix, ids, counts = slab + 1, key, [], []
            ids.append(digest)
            counts.append(words)
            state = (slab, prefix, ids, counts, _key(key, digest))
        yield table(rows)
    if own:
        yield table([row(True)])


def rebuilt(conversations: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """Segments of every conversation c, whose first h = crc32(c) % head turns are those of conversation c - c % family.

    Turns are ordered by turn (null first), ties by the digest of role and text. Turns are dealt by conversation and streamed in
    order, so a task holds one segment, however long a conversation is; of a donor only its first turns are copied.
    """
    turns = _turns(conversations)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    first = turns.where(F.col("conv_id") % family == 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") < head)
    low = F.col("conv_id") - F.when(F.col("conv_id") <= 0, family - 1).otherwise(0)
    high = F.col("conv_id") + F.when(F.col("conv_id") >= 0, family - 1).otherwise(0)
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    donated = first.withColumn("conv_id", F.explode(F.sequence(low, high))).where(F.col("rank") <= taken)
    rows = donated.withColumn("kind", F.lit(0)).drop("rank").unionByName(turns.withColumn("kind", F.lit(1))).withColumn("skip", taken)
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "digest")
    return dealt.select("conv_id", "kind", "skip", "digest", "words").mapInArrow(released(_segments), SEGMENT)


class Tree:
    """A trie whose children form a binary search tree each: a ternary search tree. Node 0 is the root; parents come before children."""

    def __init__(self):
        self.symbol, self.parent, self.words = [-1], [-1], [0]
        self.down, self.less, self.more = [-1], [-1], [-1]

    def child(self, node: int, symbol: int, words: int) -> int:
        """The child of ``node`` for ``symbol``, made if there is none."""
        links, slot = self.down, node
        while (at := links[slot]) >= 0:
            if symbol == self.symbol[at]:
                return at
            links, slot = (self.less if symbol < self.symbol[at] else self.more), at
        links[slot] = new = len(self.symbol)
        for column, value in ((self.symbol, symbol), (self.parent, node), (self.words, words), (self.down, -1), (self.less, -1), (self.more, -1)):
            column.append(value)
        return new

    def insert(self, symbols: list[int], words: list[int]) -> list[int]:
        """The nodes of a sequence, from the root's child on."""
        path, node = [], 0
        for s, w in zip(symbols, words):
            node = self.child(node, s, w)
            path.append(node)
        return path


def medians(n: int):
    """0 to n - 1, the median of each range before its halves: sorted sequences inserted so keep the search trees balanced."""
    waiting = [(0, n)]
    while waiting:
        lo, hi = waiting.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            waiting += [(lo, mid), (mid + 1, hi)]


NODE = (
    "key binary, parent_key binary, conv_id long, depth long, n_convs long, words long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, parent_conv_id long, shared boolean, open boolean, path array<binary>, front binary"
)


def _nodes(slab: int, prefix: bytes, rows: list, left: bool, right: bool) -> list[tuple]:
    """The nodes that sorted rows (conv_id, ids, words, last) below one segment's start make, as rows of NODE.

    Nodes that another chunk may have too are shared: the root, the paths of the first row if ``left`` and of the last row if ``right``,
    and nodes where a conversation goes on in the next slab. Leaves and savings of a node leave out what lies in shared nodes below
    (``open`` tells that there are such) and, of a shared node, its own.
    """
    distinct: list[tuple[bytes, bytes, list, list]] = []
    for conv, ids, words, last in rows:
        if not distinct or distinct[-1][0] != ids:
            distinct.append((ids, words, [], []))
        distinct[-1][2 if last else 3].append(conv)
    joined = np.frombuffer(b"".join(d[0] for d in distinct), f"V{WIDTH}")
    names, code = np.unique(joined.view((np.uint8, WIDTH)), axis=0, return_inverse=True) if len(joined) else (joined, joined)
    digests = [bytes(x) for x in names]
    upto = np.concatenate(([0], np.cumsum([len(d[0]) // WIDTH for d in distinct])))
    tree, ended, going = Tree(), {}, {}
    paths = {}
    for k in medians(len(distinct)):
        _, words, ends, on = distinct[k]
        path = tree.insert(code[upto[k] : upto[k + 1]].tolist(), np.frombuffer(words, "<i8").tolist())
        node = path[-1] if path else 0
        if ends:
            ended[node] = sorted(ends)
        if on:
            going[node] = on
        if (left and k == 0) or (right and k == len(distinct) - 1):
            paths[k] = path
    n = len(tree.symbol)
    shared, open_, key, depth = [False] * n, [False] * n, [prefix] * n, [slab * SLAB] * n
    for node in [0, *(x for p in paths.values() for x in p), *going]:
        shared[node] = True
    members, least, kids, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    for node in range(1, n):
        above = tree.parent[node]
        key[node], depth[node] = _key(key[above], digests[tree.symbol[node]]), depth[above] + 1
    for node in range(n - 1, -1, -1):
        for some in (ended.get(node), going.get(node)):
            if some:
                members[node] += len(some)
                least[node] = min(x for x in (least[node], min(some)) if x is not None)
        if not shared[node]:
            leaves[node] += not kids[node]
            saved[node] += (members[node] - 1) * tree.words[node]
        above = tree.parent[node]
        if node:
            members[above] += members[node]
            least[above] = min(x for x in (least[above], least[node]) if x is not None)
            kids[above] += not (shared[node] and shared[above])
            open_[above] = open_[above] or shared[node] or open_[node]
            if not shared[node]:
                leaves[above] += leaves[node]
                saved[above] += saved[node]
    out = []
    for node in range(n):
        above, path = tree.parent[node], None
        if shared[node]:
            path, at = [], node
            while at > 0:
                path.append(key[at])
                at = tree.parent[at]
            if node == 0 and slab == 0:
                path = [key[0]]
        again = node == 0 and slab > 0  # counted where the slab before ends
        ends = ",".join(map(str, ended.get(node, ()))).encode()
        out.append((
            key[node], key[above] if node else None, None if again else least[node], depth[node], 0 if again else members[node], tree.words[node],
            kids[node], leaves[node], saved[node], None if shared[node] else hashlib.sha256(ends).hexdigest(),
            least[above] if node and not shared[above] else None, shared[node], open_[node], None if again else path, prefix if node and shared[node] else None,
        ))
    return out


def _trees(batches):
    """Sorted segments to nodes, chunk by chunk."""
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.binary()), pa.binary()]
    names = [x.split()[0] for x in NODE.split(", ")]

    def made(chunk):
        groups: dict = {}
        for slab, prefix, *row in chunk:
            groups.setdefault((slab, prefix), []).append(row)
        rows = []
        for k, ((slab, prefix), group) in enumerate(groups.items()):
            rows += _nodes(slab, prefix, group, left=k == 0, right=k == len(groups) - 1)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    chunk, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("slab", "prefix", "conv_id", "ids", "words", "last"))):
            chunk.append(row)
            size += 1 + len(row[3]) // WIDTH
            if size >= CHUNK:
                yield made(chunk)
                chunk, size = [], 0
    if chunk:
        yield made(chunk)


def _ends(batches):
    """SHA-256 over the conv_ids of each key, comma-joined, as sorted rows (key, conv_id) stream by."""
    key, state = None, None

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])

    for batch in batches:
        rows = []
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if state is not None:
                    rows.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(str(conv).encode())
            else:
                state.update(f",{conv}".encode())
        yield table(rows)
    if state is not None:
        yield table([(key, state.hexdigest())])


def _small(df: DataFrame) -> DataFrame:
    """A written table of a few columns, broadcast within a bound on its rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS // 10 else df


def prefix_trie(segments: DataFrame) -> DataFrame:
    """The trie of conversations given as written segments (see ``rebuilt``), one row per node: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Segments are sorted by range, so that those with common first turns stand together. A task takes them in chunks: it codes the
    chunk's turns by a dictionary, inserts the distinct segments into a ternary search tree, medians first, and adds up members, leaves
    and savings in one pass from the last node to the first. What a chunk may have in common with others, the paths of its first and
    last row, the root and the ends of full segments, is merged by key; the merged nodes' own leaves and savings are then sent
    to the at most SLAB nodes above them in their slab, and from slab to slab along the segments of one member. So one prefix, one
    conversation or one repeated conversation may hold any share of all rows: no task holds more than a chunk, no step repeats per level.
    """
    ordered = segments.repartitionByRange("slab", "prefix", "ids", "conv_id").sortWithinPartitions("slab", "prefix", "ids", "conv_id")
    nodes = stored(ordered.mapInArrow(released(_trees), NODE), "trie-nodes")
    both = nodes.where("shared")
    merged = both.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.max("words").alias("words"), F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"),
        F.first("path", ignorenulls=True).alias("path"), F.max("front").alias("front"),
        F.max("parent_conv_id").alias("parent_conv_id"),
    )
    below = both.where("parent_key IS NOT NULL").select("key", "parent_key").distinct().groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    merged = merged.join(below, "key", "left").withColumn("n_children", F.col("kids") + F.coalesce("more", F.lit(0)))
    own = (F.col("l") + (F.col("n_children") == 0).cast("long")).alias("l"), (F.col("s") + (F.col("n_convs") - 1) * F.col("words")).alias("s")
    merged = stored(merged.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", *own, "path", "front", "parent_conv_id"), "trie-shared")

    inside = merged.where("front IS NOT NULL").groupBy(F.col("front").alias("key")).agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    through = inside
    deep = inside.join(merged.select("key", "conv_id", (F.col("depth") / SLAB).cast("int").alias("slab")), "key").where("slab > 0")
    if deep.limit(1).count():  # some conversation is longer than a slab: its slabs' starts pass on what lies below them
        earlier = segments.select("conv_id", F.col("slab").alias("at"), F.col("prefix").alias("start"))
        passed = deep.join(earlier, "conv_id").where("at < slab").select(F.col("start").alias("key"), "l", "s")
        through = inside.union(passed).groupBy("key").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    upward = merged.select("path", "l", "s").union(merged.select("key", "path").join(through, "key").select("path", "l", "s"))
    added = upward.select(F.explode("path").alias("key"), "l", "s").groupBy("key").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    added = _small(stored(added, "trie-added"))

    plain = ["key", "parent_key", "conv_id", "depth", "n_convs", "n_children"]
    total = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "l"), ("saved_tokens", "s"))]
    alone = nodes.where("NOT shared")
    closed = alone.where("NOT open").select(*plain, "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id")
    opened = alone.where("open").join(added, "key", "left").select(*plain, *total, "ends_sha256", "parent_conv_id")
    last = segments.where("last").select(F.col("end_key").alias("key"), "conv_id").join(_small(merged.select("key")), "key", "left_semi")
    digests = last.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(released(_ends), "key binary, ends_sha256 string")
    common = merged.drop("l", "s").join(added.withColumnsRenamed({"l": "n_leaves", "s": "saved_tokens"}), "key").join(digests, "key", "left")
    common = common.select(*plain, "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "parent_conv_id")
    above = _small(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
    whole = closed.union(opened).union(common).join(above, "parent_key", "left")
    return whole.select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def conversation_trie(conversations: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """``prefix_trie`` of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Null role or text is empty; turns are ordered by turn, null first, ties by a digest of role and text; repeated rows are turns each.
    Rows without conv_id belong to no conversation and make none. Turns are equal if the first 128 bits of their SHA-256 are.
    An empty table has no node, not even a root. Further columns are ignored.
    """
    return prefix_trie(stored(rebuilt(conversations, family, head), "segments"))


@query("op11_conversation_trie", r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM ids),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT c.conv_id, 0 AS kind, rn, role, text FROM crc c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND rn <= h
  UNION ALL SELECT c.conv_id, 1, rn, role, text FROM crc c JOIN turns t ON t.conv_id = c.conv_id AND rn > h),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY kind, rn) AS turns FROM rebuilt GROUP BY conv_id),
seqs AS (SELECT conv_id, coalesce(turns, []) AS turns FROM ids LEFT JOIN lists USING (conv_id)),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM seqs),
nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM steps GROUP BY ALL),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(n.path[depth].text, '[^\x20\x09-\x0D]+')) END AS saving
  FROM nodes n LEFT JOIN children c ON n.path = c.path),
spread AS (SELECT path[1:k] AS path, n_children, saving FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM valued)),
sums AS (SELECT path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM spread GROUP BY path)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON v.path = s.path LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[1:v.depth - 1] AND p.depth = v.depth - 1""")
def op11_conversation_trie(spark, sf_dir):
    return conversation_trie(read(spark, sf_dir, "conversations"))
