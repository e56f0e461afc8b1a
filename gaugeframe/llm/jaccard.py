"""Documents whose sets of word shingles are alike: an exact Jaccard join by prefixes under several token orders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.arrays import LOWER_SYMBOLS, U64, Ranges, batchwise, binaries, groupwise, mixed, narrow, runs, widen, word_bounds
from gaugeframe.llm.components import components
from gaugeframe.llm.storage import parts_of, stored

#: A token's bytes within its part. With the part they name it to 40 + log2(parts) bits.
WIDTH = 5
#: Bytes of a token with its part.
NAME = WIDTH + 2
#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1
#: Texts are tokenised together up to so many bytes; this bounds memory and changes no result.
CHUNK = 1 << 20
#: Members of a bucket in a block, and tokens in a product of matrices.
BLOCK, COLUMNS = 256, 4096
#: Chunks that share packed rows.
CHUNKS = 6
#: Bytes of a sampled token within its part. Two tokens taken for one only let a set stay.
SHORT = 4
#: Words of 64 bits that mark the nodes of sets that stay: 1 bit for each node, other nodes may have the same. They are broadcast.
WORDS = 1 << 20
#: Parts, at least, if the session shuffles into so many.
FEW = 8
#: Salts of the token orders beside the one by frequency.
ORDERS = (U64(0), U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7))


def chunked(hashes: np.ndarray, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK or i + 1 == len(texts):
            yield hashes[start : i + 1], held
            start, size, held = i + 1, 0, []


def document_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of the distinct k-word shingles of some texts, in order of both; a text of fewer words has one."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    words = Ranges(LOWER_SYMBOLS[data]).of(starts, ends)
    first_byte = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    first = np.searchsorted(starts, first_byte)
    count = np.diff(np.append(first, len(starts)))
    ranges, doc = Ranges(words), np.repeat(np.arange(len(texts)), count)
    whole = doc[: max(0, len(words) - k + 1)] == doc[k - 1 :] if len(words) >= k else np.zeros(0, bool)
    tokens, owner = ranges.every(k)[whole], doc[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        tokens = np.concatenate([tokens, ranges.of(first[short], first[short] + count[short])])
        owner = np.concatenate([owner, short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], tokens[new]


PACKED = "part int, nodes binary, sizes binary, counts binary, tokens binary"


def _grouped(k: int, rows: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]):
    """Texts to `rows` of the node hashes of a group of texts and their (document, token).

    Equal texts of a task count once. Groups are a few chunks of text, so a task's memory doesn't depend on its batches.
    """

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, h in enumerate(batch.column(0).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    new.append(i)
            hashes, texts = batch.column(0).to_numpy()[new], batch.column(1)
            held: list[tuple] = []
            for at in range(0, len(new), 500):
                for some, chunk in chunked(hashes[at : at + 500], texts.take(pa.array(new[at : at + 500], pa.int64())).to_pylist()):
                    held.append((some, *document_sets(chunk, k)))
                    if len(held) == CHUNKS:
                        yield rows(*_joined(held))
                        held = []
            if held:
                yield rows(*_joined(held))

    return f


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] + f for h, f in zip(held, first, strict=True)]), np.concatenate([h[2] for h in held])


def _by_part(owner: np.ndarray, token: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners and tokens in order of their parts, without the bits that name the part, and where each part begins."""
    part = ((token & U64(0xFFFF)) % U64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return owner[order], token[order] >> U64(24), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


SAMPLED = "part int, team long, owners binary, tokens binary"
LONE = "part int, team long, owners binary, counts binary"


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers below 65,536 as steps, low bytes first, as the high ones are nearly always 0."""
    return np.diff(x, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel(), dtype=np.int64)


def _sample(k: int, parts: int, share: int):
    """Of `share` in 256 tokens, the same ones of every text: for a group of texts and a part, the tokens and whose they are.

    A text goes by its place in the group, so a token costs 6 bytes at most, into however many parts they are dealt.
    The group's row in part -1 has the nodes and set sizes.
    """

    def rows(hashes: np.ndarray, owner: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        nodes, sizes = hashes.astype("<i8").tobytes(), np.bincount(owner, minlength=len(hashes)).astype("<i4").tobytes()
        # groups of one name have the same texts, so no token of theirs is alone
        team = int.from_bytes(blake2b(nodes, digest_size=8).digest(), "little", signed=True)
        some = ((token >> U64(16)) & U64(0xFF)) < U64(share)
        owner, token, cuts = _by_part(owner[some], token[some], parts)
        out = [(-1, team, nodes, sizes)]
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            out.append((p, team, _steps(owner[a:b]), narrow(token[a:b], SHORT)))
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["part", "team", "owners", "tokens"])

    return _grouped(k, rows)


def _lone(table: pa.Table) -> pa.Table:
    """For each group of texts, how many of a text's sampled tokens in this part stand nowhere else."""
    part, names = table.column("part")[0].as_py(), [c.split()[0] for c in LONE.split(", ")]
    if part < 0:
        return table.rename_columns(names)
    packed = table.column("tokens").to_pylist()
    tokens = np.frombuffer(b"".join(packed), f"<u{SHORT}")
    order = np.argsort(tokens)
    head = runs(tokens[order])
    lone = np.zeros(len(tokens), bool)
    lone[order[head[np.diff(np.append(head, len(tokens))) == 1]]] = True
    rows, at = [], 0
    for team, owners in zip(table.column("team").to_pylist(), table.column("owners").to_pylist(), strict=True):
        owner = _unstepped(owners)
        held, counts = np.unique(owner[lone[at : at + len(owner)]], return_counts=True)
        at += len(owner)
        if len(held):
            # a count that doesn't fit lets a set stay
            rows.append((part, team, _steps(held), np.minimum(counts, 255).astype(np.uint8).tobytes()))
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _stays(percent: int):
    """Which texts of a group may have a partner: without the lone tokens found, enough of the set is left."""

    def f(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        owners, counts = table.column("owners").to_pylist(), table.column("counts").to_pylist()
        first = int(np.flatnonzero(part < 0)[0])
        nodes, sizes = np.frombuffer(owners[first], "<i8"), np.frombuffer(counts[first], "<i4")
        lone = np.zeros(len(nodes), np.int64)
        for i in np.flatnonzero(part >= 0).tolist():
            lone[_unstepped(owners[i])] += np.frombuffer(counts[i], np.uint8)
        left = sizes.astype(np.int64) - lone
        # texts without words may be in several groups; the sets that go are in one
        return pa.table([pa.array(nodes), pa.array(sizes), pa.array((sizes == 0) | (left >= least_overlap(sizes.astype(np.int64), percent)))], names=["node", "size", "stays"])

    return f


def _pack(k: int, parts: int):
    """Texts to packed rows: for a group of texts and a part, the tokens of each text that fall in the part. Part -1 has all set sizes."""

    def rows(hashes: np.ndarray, owner: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        sizes = np.bincount(owner, minlength=len(hashes)).astype(np.int32)
        owner, token, cuts = _by_part(owner, token, parts)
        out = [(-1, hashes.astype("<i8").tobytes(), sizes.tobytes(), b"", b"")]
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                own = owner[a:b]
                first = runs(own)
                held = own[first]
                counts = np.diff(np.append(first, b - a)).astype(np.int32)
                out.append((p, hashes[held].astype("<i8").tobytes(), sizes[held].tobytes(), counts.tobytes(), narrow(token[a:b], WIDTH)))
        names = ["part", "nodes", "sizes", "counts", "tokens"]
        types = [pa.int32()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return _grouped(k, rows)


SHARED = "dest int, part int, nodes binary, sizes binary, shared binary, tokens binary, often binary"


def _share(parts: int):
    """The tokens of one part that stand in two sets or more, with how many sets have them, for the sets of each destination.

    Numbers of sets are steps of an eighth of their logarithm, as they only order tokens, and the same for a token everywhere.
    """

    def f(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        nodes, sizes = join("nodes", "<i8"), join("sizes", "<i4")
        once = np.unique(nodes, return_index=True)[1]  # a text may have come with several batches
        if part < 0:
            nodes, sizes = nodes[once], sizes[once]
            shared, tokens, often = np.zeros(len(nodes), np.int32), np.zeros(0, U64), np.zeros(0, np.uint8)
        else:
            counts, tokens = join("counts", "<i4"), widen(b"".join(table.column("tokens").to_pylist()), WIDTH)
            owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
            if len(once) < len(nodes):
                first = np.zeros(len(nodes), bool)
                first[once] = True
                owner, tokens = owner[first[owner]], tokens[first[owner]]
            # one array of 8 bytes a token beside the tokens at a time: a part is most of a task's memory
            order = np.argsort(tokens)
            head = runs(tokens[order])
            sets = np.diff(np.append(head, len(tokens)))
            steps = np.where(sets >= 2, np.minimum(8 * np.log2(sets), 255), 0).astype(np.uint8)
            often = np.empty(len(tokens), np.uint8)
            often[order] = np.repeat(steps, sets)
            del order, head, sets, steps
            keep = often > 0
            owner, tokens, often = owner[keep], tokens[keep], often[keep]
            head = runs(owner)
            shared = np.diff(np.append(head, len(owner))).astype(np.int32)
            nodes, sizes = nodes[owner[head]], sizes[owner[head]]
        dest = (mixed(nodes.view(U64)) % U64(parts)).astype(np.int64)
        by, of_token = np.argsort(dest, kind="stable"), np.repeat(dest, shared)
        by_token = np.argsort(of_token, kind="stable")
        cuts, token_cuts = (np.concatenate([[0], np.cumsum(np.bincount(d, minlength=parts))]) for d in (dest, of_token))
        rows = []
        for d in np.unique(dest).tolist():
            which, tokens_of = by[cuts[d] : cuts[d + 1]], by_token[token_cuts[d] : token_cuts[d + 1]]
            held = [x[which].tobytes() for x in (nodes, sizes.astype("<i4"), shared)]
            rows.append((d, part, *held, narrow(tokens[tokens_of], WIDTH), often[tokens_of].tobytes()))
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in SHARED.split(", ")])

    return f


def _gather(percent: int):
    """Sets of one destination: the size of each, and its shared tokens if they are enough for a partner."""

    def f(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        nodes, sizes, shared, often = join("nodes", "<i8"), join("sizes", "<i4"), join("shared", "<i4"), join("often", "u1")
        tokens = widen(b"".join(table.column("tokens").to_pylist()), WIDTH)
        part = np.repeat(table.column("part").to_numpy(), [len(x) for x in table.column("often").to_pylist()])
        tokens = (tokens << U64(16)) | part.astype(U64)
        each, place = np.unique(nodes, return_inverse=True)
        total, size = np.bincount(place, weights=shared, minlength=len(each)).astype(np.int64), np.zeros(len(each), np.int32)
        size[place] = sizes  # the same in every row of a set
        enough = (total > 0) & (total * 100 >= size.astype(np.int64) * percent)
        owner = np.repeat(place, shared)
        order = np.argsort(owner, kind="stable")
        order = order[enough[owner[order]]]
        ends = np.cumsum(total[enough])
        held = [binaries(narrow(tokens[order], NAME), ends * NAME), binaries(often[order].tobytes(), ends)]
        some = pa.table([pa.array(each[enough]), pa.array(size[enough]), *held], names=["node", "size", "tokens", "counts"])
        none = int((~enough).sum())
        rest = pa.table([pa.array(each[~enough]), pa.array(size[~enough]), *[pa.nulls(none, pa.binary())] * 2], names=some.column_names)
        return pa.concat_tables([some, rest])

    return f


def _names(tokens: bytes) -> np.ndarray:
    return widen(tokens, NAME)


def least_overlap(n: int, percent: int) -> int:
    """A partner must hold so many of a set's n tokens, as the union has n at least."""
    return -(-percent * n // 100)


def _prefix(order: int, tokens: np.ndarray, df: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The first shared tokens under an order, so many that any set alike shares one: order 0 and 1 put rare tokens first."""
    salted = mixed(tokens ^ ORDERS[order])
    by = np.lexsort((salted, df)) if order < 2 else np.argsort(salted)
    return tokens[by[: max(0, len(tokens) - least_overlap(n, percent) + 1)]]


def _postings(percent: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prefixes, sizes = [], [], []
            for node, n, tokens, df in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                p = _prefix(0, _names(tokens), np.frombuffer(df, "u1"), n, percent)
                nodes.append(np.full(len(p), node)), prefixes.append(p.view("<i8")), sizes.append(np.full(len(p), n, np.int32))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (prefixes, nodes, sizes)], names=["token", "node", "size"])

    return f


def _products(rows: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each two of n sets share, from (row, token): products of 0/1 matrices, some tokens at a time."""
    out = np.zeros((n, n), np.float32)
    order = np.argsort(tokens, kind="stable")
    rows, tokens = rows[order], tokens[order]
    place = np.cumsum(np.concatenate([[0], (tokens[1:] != tokens[:-1]).astype(np.int64)])) if len(tokens) else tokens
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        x, y = np.searchsorted(place, [low, low + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[rows[x:y], place[x:y] - low] = 1.0
        out += part @ part.T
    return out


def _spanning(x: np.ndarray, y: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between places, those that join components not yet joined: fewer than there are components."""
    parent = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    kept = []
    for i, (a, b) in enumerate(zip(component[x].tolist(), component[y].tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(i)
    return x[kept], y[kept]


def _compare_blocks(percent: int):
    """Links that join components between two blocks of a bucket. Pairs must pass the prefix filter of every order first."""

    def f(table: pa.Table) -> pa.Table:
        node, n = table.column("node").to_numpy(), table.column("size").to_numpy().astype(np.float64)
        component, block = table.column("component").to_numpy(), table.column("block").to_numpy()
        tokens = [_names(t) for t in table.column("tokens").to_pylist()]
        counts = [np.frombuffer(c, "u1") for c in table.column("counts").to_pylist()]
        row = lambda sets: np.repeat(np.arange(len(node)), [len(x) for x in sets])
        wanted = (component[:, None] != component[None, :]) & np.triu(np.ones((len(node), len(node)), bool), 1)
        if table.column("low")[0].as_py() != table.column("high")[0].as_py():
            wanted &= block[:, None] != block[None, :]
        for order in range(len(ORDERS)):
            if wanted.any():
                first = [_prefix(order, t, c, int(m), percent) for t, c, m in zip(tokens, counts, n, strict=True)]
                wanted &= _products(row(first), np.concatenate(first), len(node)) > 0
        x, y = np.nonzero(wanted)
        if len(x):
            both = _products(row(tokens), np.concatenate(tokens), len(node))[x, y]
            link = 100 * both >= percent * (n[x] + n[y] - both)
            x, y = _spanning(x[link], y[link], component)
        return pa.table([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    return f


def _verify(percent: int):
    """Pairs that pass the prefix filters of the other orders too, and then the count of shared tokens."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, n, m, s, t, f, g in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                s, t, f, g = _names(s), _names(t), np.frombuffer(f, "u1"), np.frombuffer(g, "u1")
                for order in range(1, len(ORDERS)):
                    if not len(np.intersect1d(_prefix(order, s, f, n, percent), _prefix(order, t, g, m, percent), assume_unique=True)):
                        break
                else:
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (n + m - both):
                        a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return f


def _marks(staying: DataFrame) -> DataFrame:
    """(_word, _bits) of at most `WORDS` words with the bits of all nodes of `staying`."""
    return staying.select(_word("node").alias("_word"), _bit("node").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _word(node: str) -> Column:
    return F.pmod(F.col(node), F.lit(WORDS))


def _bit(node: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned({node}, 58) as int))")


def shingle_sets(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Stored (node, size, tokens, counts) of the distinct texts of (node, text); tokens are kept only where enough are shared.

    A token that stands in one set only can't be shared, so a set of which fewer than `percent` % of the tokens stand
    elsewhere has no partner and is done. Most sets are known for such by a part of their tokens, 8 for every 5 that they may
    have alone, so at first only these travel, named by 4 bytes in their part. Nothing is decided by what they share: a set goes
    if it has too many lone ones among them. Nodes of sets that stay set a bit of a table that is broadcast, and of texts
    with such a bit all tokens travel in packed rows, to their part one for some texts and a part, and back to their sets
    one for a part and a destination.
    """
    parts = parts_of(texts.sparkSession)
    texts = texts.select("node", "text")
    share = min(256, -(-256 * 8 * (100 - percent) // 500))
    sampled = texts.mapInArrow(batchwise(_sample(k, max(min(parts, FEW), parts // 2), share)), SAMPLED)
    # nodes and sizes are dealt out like any part
    lone = sampled.groupBy("part", F.when(F.col("part") < 0, F.pmod("team", F.lit(parts)))).applyInArrow(groupwise(_lone), LONE)
    told = stored(lone.groupBy("team").applyInArrow(groupwise(_stays(percent)), "node long, size int, stays boolean"), "told")
    marks = F.broadcast(_marks(told.filter("stays")))
    marked = F.coalesce(F.col("_bits").bitwiseAND(_bit("node")), F.lit(0)) != 0
    gone = told.withColumn("_word", _word("node")).join(marks, "_word", "left").filter(~marked)
    staying = texts.withColumn("_word", _word("node")).join(marks, "_word").filter(marked).select("node", "text")
    # as many parts as the tokens that are left take
    total, left = told.agg(F.sum(F.col("size").cast("long")), F.sum(F.when(F.col("stays"), F.col("size").cast("long")))).first()
    parts = max(min(parts, FEW), -(-parts * (left or 0) // max(total or 0, 1)))
    packed = staying.mapInArrow(batchwise(_pack(k, parts)), PACKED)
    shared = packed.groupBy("part", F.when(F.col("part") < 0, F.pmod(F.xxhash64("nodes"), F.lit(parts)))).applyInArrow(groupwise(_share(parts)), SHARED)
    sets = stored(shared.groupBy("dest").applyInArrow(groupwise(_gather(percent)), "node long, size int, tokens binary, counts binary"), "shingles")
    return sets.unionByName(gone.select("node", "size"), allowMissingColumns=True)


def _classes(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, node, n_shingles, component, least) of every row: the component's name and its least doc_id."""
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    sets = shingle_sets(keyed, k, percent)
    live = sets.filter(F.col("tokens").isNotNull())
    postings = stored(live.select("node", "size", "tokens", "counts").mapInArrow(batchwise(_postings(percent)), "token long, node long, size int"), "postings")
    # the members of a bucket against the least of them
    least = F.min(F.struct("node", "size"))
    pivots = postings.groupBy("token").agg(least.alias("pivot"), F.max("node").alias("_most")).filter("pivot.node != _most")
    pivots = pivots.select("token", F.col("pivot.node").alias("y"), F.col("pivot.size").alias("m"))
    # sizes are compared before the tokens of a pair are fetched
    close = (F.col("size") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("size") * percent)
    pairs = postings.join(pivots, "token").filter("node != y").filter(close).select(F.col("node").alias("x"), "y").distinct()
    left = live.select(F.col("node").alias("x"), F.col("size").alias("n"), F.col("tokens").alias("s"), F.col("counts").alias("f"))
    right = live.select(F.col("node").alias("y"), F.col("size").alias("m"), F.col("tokens").alias("t"), F.col("counts").alias("g"))
    joined = pairs.join(left, "x").join(right, "y").select("x", "y", "n", "m", "s", "t", "f", "g")
    edges = stored(joined.mapInArrow(batchwise(_verify(percent)), "a long, b long"), "links")
    # buckets that still have several components beside the least member, whose links are known: blocks of the rest against each other
    labelled = postings.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = F.min("component").alias("_least"), F.max("component").alias("_most")
    open_ = labelled.groupBy("token").agg(F.min("node").alias("pivot"), *several, F.count(F.lit(1)).alias("_n"))
    open_ = open_.filter("_least != _most and _n > 2").select("token", "pivot")
    # any two members of a bucket are also members of its pivot's group, and most tokens of a document have one pivot
    members = labelled.join(open_, "token").filter("node != pivot").select("pivot", "node", "size", "component").distinct()
    members = stored(members, "members")
    counts = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), *several)
    counts = counts.filter("_least != _most").select("pivot", "blocks")
    dealt = members.join(counts, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(live.select("node", "tokens", "counts"), "node").select(
        "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "size", "component", "block", "tokens", "counts"
    )
    more = dealt.groupBy("pivot", "low", "high").applyInArrow(groupwise(_compare_blocks(percent)), "a long, b long")
    edges = edges.union(stored(more, "links"))
    labels = components(edges)
    texts = keyed.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("least"))
    sized = sets.select("node", F.col("size").cast("long").alias("n_shingles")).join(texts, "node").join(labels, "node", "left")
    named = sized.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("least"))
    return keyed.select("doc_id", "node").join(named.drop("least").join(smallest, "component"), "node")


def similar_groups(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text).

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of k-word shingles (a text of fewer
    words has one, its whole sequence); a component is what links reach, named by its smallest doc_id.

    Candidates come from prefix tokens. Under any order of all tokens, two sets that link share one of their first
    n - ceil(percent * n / 100) + 1 tokens. Order 0 (rare tokens first) makes the buckets; a candidate pair must also
    share a prefix token under order 1 (rare first, other ties) and order 2 (by hash) before its tokens are counted.
    A bucket never emits its pairs: first its members are compared with the least of them, and what these links join is one
    component. A link not found by then joins two components that share a bucket, and not its least member, whose links are
    all known. So the other members of buckets with several components are dealt out in blocks, and tasks compare two blocks
    at a time, across components only, by products of 0/1 matrices. Members that don't link with each other cost a square of their number there, but no row.

    Equal texts are one node, linked by definition; hashes of texts have 64 bits, tokens 40 + log2(parts). Texts that are null, empty or
    without words have n_shingles 0 and are alone. Null doc_ids rank after all others in component_id and stand for
    themselves when alone; repeated rows give a row each. An empty table gives an empty result. Other columns are not used.
    """
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.nullif("least", F.lit(LAST)))
    return _classes(documents, k, percent).select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The documents, all columns, without those that link (see `similar_groups`) to one that stays: of each group the one
    with the least doc_id. Texts without words all stay. Of repeated rows, or of a group with null doc_ids only, any one stays."""
    found = stored(_classes(documents, k, percent), "classes")
    first = found.filter((F.col("n_shingles") == 0) | (F.coalesce("doc_id", F.lit(LAST)) == F.col("least")))
    first = first.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "component", "n_shingles").distinct()
    same = documents["doc_id"].cast("long").eqNullSafe(first["_id"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == first["_node"])
    columns = [documents[c] for c in documents.columns]
    more = found.filter("n_shingles > 0").filter(F.coalesce("doc_id", F.lit(LAST)) == F.col("least")).groupBy("component").count().filter("count > 1")
    if more.isEmpty():
        return documents.join(first, same, "left_semi")
    rows = documents.join(first, same).select(F.struct(*columns).alias("_row"), "component", "n_shingles")
    once = rows.filter("n_shingles > 0").dropDuplicates(["component"]).unionByName(rows.filter("n_shingles = 0"))
    return once.select("_row.*")
