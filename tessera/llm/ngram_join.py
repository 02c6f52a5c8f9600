"""N-gram Jaccard join by prefix trees.

Each document is its set of distinct 5-word shingles (64-bit hashes). All sets follow one global order, frequent
shingles last, so that two sets that link must share k shingles among the first n - ceil(0.75 n) + k of each.

1. One pass gives every document's size and set fingerprint, and counts shingles that recur within a window of the
   pass. The most frequent (a fixed number) are the end of the order; any total order gives the same links.
2. One pass deals the leading shingles. Rare ones meet in a shuffle and put the documents that share one into a
   group. Frequent ones need no shuffle: the group each belongs to is in the broadcast list. Documents that share too
   few of their leading shingles to link leave.
3. The sets of each group's documents (one for each distinct set) are dealt in blocks of bounded size. A block
   keeps them in a path-compressed trie in the global order, read from its common end, so that documents share the paths
   they have in common. Every set walks the trie of those before it: overlaps on shared paths are counted once, and a
   subtree is left when even its remaining length can't reach the needed overlap, or when all of it is linked already.
4. Groups of more than one block also put a few anchors into each. Where their documents aren't one component
   after that, the outliers meet every block of the group, so that no link is lost.

These links are a spanning forest: pairs known to be connected aren't compared again. Where numbers of links are asked
for, every pair of blocks of a group meets once more, and every pair of sets is counted in the first group they share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fitting, map_arrow, materialise, mix, semi_by_id, slice_hashes, text_batches, utf8, word_spans
from tessera.llm.components import components

WIDTH, PERCENT = 5, 75
#: Shingles that one window of the first pass counts together, and the number of frequent shingles that are ordered by count.
WINDOW, FREQUENT = 1 << 22, 1 << 19
#: Documents and shingles of a block, and documents that all blocks of a group share.
BLOCK, BLOCK_SHINGLES, ANCHORS = 512, 1 << 21, 8
#: Parts that the rows of a group are dealt in where they meet what is known of the group.
SALTS = 256
#: Elements of so many sets are counted by pairs of sets, others as products of so many columns.
RARE, COLUMNS = 8, 4096
#: Sets that link share at least n / EXTRA leading shingles, as so many more than needed for one are taken.
EXTRA = 10
_TURN = [np.uint64(x) for x in np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; with fewer words than the width, the whole sequence as one."""
    starts, ends, upto = word_spans(raw, at)
    words = slice_hashes(raw, starts, ends, lower=True)
    windows = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width if len(windows) else 0):
        windows += words[i : i + len(windows)] * _TURN[i]
    windows = mix(windows + np.uint64(width))
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(windows[a : b - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            out.append(mix(np.array([sum(int(words[a + i]) * int(_TURN[i]) for i in range(b - a)) + (b - a) & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, and two sums of differently mixed shingles; equal for equal sets."""
    lens = np.array([len(s) for s in sets], np.int64)
    total = np.concatenate([*sets, np.zeros(1, np.uint64)])
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(total ^ np.uint64(salt)))])
        edge = np.concatenate([[0], np.cumsum(lens)])
        out.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
    return lens, out[0], out[1]


def _survey(width: int, window: int):
    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n", "fp1", "fp2", "token", "times"]
        held: list[np.ndarray] = []
        owner: list[int] = []
        seen: set = set()

        def recurring():
            tokens = np.concatenate(held)
            ids = np.repeat(np.array(owner, np.int64), [len(x) for x in held])
            order = np.argsort(tokens, kind="stable")
            tokens, ids = tokens[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            times = np.diff(np.concatenate([first, [len(tokens)]]))
            often = np.flatnonzero(times >= 3)
            least = np.minimum.reduceat(ids, first)[often] if len(first) else first
            nothing = pa.nulls(len(often), pa.int64())
            held.clear(), owner.clear(), seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(least), nothing, nothing, nothing, pa.array(tokens[first[often]].view(np.int64)), pa.array(times[often])], names)

        size = 0
        for keys, raw, at in text_batches(batches, "doc_id", "text"):
            sets = shingle_sets(raw, at, width)
            lens, fp1, fp2 = _set_fingerprints(sets)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(lens), pa.array(fp1), pa.array(fp2), none, none], names)
            for i, key in enumerate(keys.to_pylist()):
                if lens[i] and key is not None and (mark := (int(fp1[i]), int(fp2[i]))) not in seen:
                    seen.add(mark)
                    held.append(sets[i])
                    owner.append(key)
                    size += int(lens[i])
                    if size >= window:
                        yield recurring()
                        size = 0
        if held:
            yield recurring()

    return run


def _leading(width: int, percent: int, frequent):
    """Rows (token, group, doc_id, times): a rare leading shingle with its document (group null), or the group of so
    many frequent ones."""

    def run(batches):
        import pyarrow as pa

        tokens, rank, group = frequent.value
        seen: set = set()
        for keys, raw, at in text_batches(batches, "doc_id", "text"):
            sets = shingle_sets(raw, at, width)
            lens, fp1, fp2 = _set_fingerprints(sets)
            rare, rare_of, often, often_of, often_times = [], [], [], [], []
            if len(seen) > 1_000_000:
                seen.clear()
            for i, key in enumerate(keys.to_pylist()):
                mark = (int(fp1[i]), int(fp2[i]))
                if not lens[i] or key is None or mark in seen:
                    continue
                seen.add(mark)
                x, n = sets[i], int(lens[i])
                take = n + (-percent * n // 100) + max(1, n // EXTRA)
                if len(tokens):
                    at_ = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                    hot = tokens[at_] == x
                    cold = x[~hot]
                    if len(cold) < take:
                        late = at_[hot]
                        late = late[np.argsort(rank[late])][: take - len(cold)]
                        found, times = np.unique(group[late], return_counts=True)
                        often.append(found)
                        often_of.append(np.full(len(found), key, np.int64))
                        often_times.append(times)
                    x = cold
                x = x[:take]
                rare.append(x)
                rare_of.append(np.full(len(x), key, np.int64))
            if rare:
                x = np.concatenate(rare).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(np.concatenate(rare_of)), pa.nulls(len(x), pa.int64())], ["token", "group", "doc_id", "times"])
            if often:
                x = np.concatenate(often)
                docs = np.concatenate(often_of)
                key = mix(x.view(np.uint64) ^ mix(docs.view(np.uint64))).view(np.int64)  # deals these rows evenly
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x), pa.array(docs), pa.array(np.concatenate(often_times))], ["token", "group", "doc_id", "times"])

    return run


def _sharing(batches):
    """Rows (token, group, doc_id, times) sorted by token and doc_id: (group, doc_id, shared) of the documents that share
    a token with another, the group being the first of them. One row of a token is remembered between batches. Rows
    that have a group pass."""
    import pyarrow as pa

    last_token = last_doc = None  # of the run that the last batch ended in: its token, its first document
    told = False  # whether that first document's own row went out
    for batch in batches:
        plain = np.asarray(batch.column(1).is_null())
        if not plain.all():
            yield batch.filter(batch.column(1).is_valid()).select(["group", "doc_id", "times"])
        tokens, docs = np.asarray(batch.column(0))[plain], np.asarray(batch.column(2))[plain]
        if not len(tokens):
            continue
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        lead = docs[first]
        goes_on = last_token is not None and tokens[0] == last_token
        size = np.diff(np.concatenate([first, [len(tokens)]]))
        shared = size > 1
        extra: list[int] = []
        if goes_on:
            lead[0] = last_doc
            shared[0] = True
            if not told:
                extra = [last_doc]
        keep = shared[run]
        group, member = lead[run][keep], docs[keep]
        if extra:
            group, member = np.concatenate([extra, group]), np.concatenate([extra, member])
        last_token, last_doc, told = tokens[-1], int(lead[-1]), bool(shared[-1])
        if len(group):
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(member, pa.int64()), pa.array(np.ones(len(group), np.int64))], ["group", "doc_id", "times"])


def _sets(width: int):
    def run(batches):
        import pyarrow as pa

        for keys, raw, at in text_batches(batches, "doc_id", "text"):
            sets = [x.tobytes() for x in shingle_sets(raw, at, width)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.binary())], ["rep", "shingles"])

    return run


class _Node:
    __slots__ = ("run", "children", "ends", "least", "most", "rest", "link")

    def __init__(self, run, least, most, rest, link):
        self.run, self.children, self.ends = run, {}, []
        self.least, self.most, self.rest = least, most, rest  # sizes of the sets below; the most that one has after this run
        self.link = link  # an element if all sets below are in its component, else -1


class Trie:
    """Sets as sorted codes below `width` on shared paths; links each new set to those before it."""

    def __init__(self, width: int, percent: int, parent: list[int]):
        self.root = _Node(np.zeros(0, np.int64), 1 << 60, 0, 0, -1)
        self.mark = np.zeros(width, bool)
        self.percent, self.parent, self.sets = percent, parent, {}

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def links(self, i: int, codes: np.ndarray) -> list[int]:
        """Sets in the trie that link with this one and weren't connected with it; they are from now on."""
        n, p, out = len(codes), self.percent, []
        self.mark[codes] = True
        own = self.find(i)
        stack = [(child, 0) for child in self.root.children.values()]
        while stack:
            node, overlap = stack.pop()
            if p * n > 100 * node.most or p * node.least > 100 * n or node.link >= 0 and self.find(node.link) == own:
                continue
            overlap += int(np.count_nonzero(self.mark[node.run]))
            ahead = n - int(np.searchsorted(codes, node.run[-1], "right"))
            if (100 + p) * (overlap + min(ahead, node.rest)) < p * (n + node.least):
                continue
            for j in node.ends:
                if (100 + p) * overlap >= p * (n + len(self.sets[j])) and self.find(j) != own:
                    out.append(j)
                    self.parent[self.find(j)] = own
            stack.extend((child, overlap) for child in node.children.values())
        self.mark[codes] = False
        return out

    def insert(self, i: int, codes: np.ndarray) -> None:
        self.sets[i] = codes
        node, at, n = self.root, 0, len(codes)
        while True:
            node.least, node.most, node.rest = min(node.least, n), max(node.most, n), max(node.rest, n - at)
            if at == n:
                node.ends.append(i)
                return
            child = node.children.get(int(codes[at]))
            if child is None:
                child = _Node(codes[at:], n, n, 0, i)
                child.ends.append(i)
                node.children[int(codes[at])] = child
                return
            run = child.run
            size = min(len(run), n - at)
            other = run[:size] != codes[at : at + size]
            same = int(other.argmax()) if other.any() else size
            if same < len(run):
                upper = _Node(run[:same], child.least, child.most, child.rest + len(run) - same, child.link)
                upper.children[int(run[same])] = child
                child.run = run[same:]
                node.children[int(codes[at])] = child = upper
            if child.link >= 0 and self.find(child.link) != self.find(i):
                child.link = -1
            node, at = child, at + same


def global_order(tokens: np.ndarray, frequent: tuple | None) -> np.ndarray:
    """Places of distinct shingles (sorted) in the global order from its common end: frequent ones by rank, then the
    others by hash. frequent: (sorted tokens, their ranks, ...)."""
    rank = np.full(len(tokens), -1, np.int64)
    if frequent is not None and len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], tokens), len(frequent[0]) - 1)
        same = frequent[0][at] == tokens
        rank[same] = frequent[1][at[same]]
    place = np.empty(len(tokens), np.int64)
    place[np.argsort(-rank, kind="stable")] = np.arange(len(tokens))
    return place


def link_block(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT, labels: list[int] | None = None, frequent: tuple | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(links, stars) of a block: a link (a, b) for each merging of two components, and (id, least id of its component in
    the block) for each linked document. labels: components known before."""
    parent = list(range(len(ids)))
    if labels is not None:
        first: dict[int, int] = {}
        parent = [first.setdefault(x, i) for i, x in enumerate(labels)]
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = global_order(tokens, frequent)[code.reshape(-1)]
    edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).tolist()
    trie, out = Trie(len(tokens), percent, parent), []
    for i in range(len(ids)):
        codes = np.sort(code[edge[i] : edge[i + 1]])
        if len(codes):
            out += [(ids[i], ids[j]) for j in trie.links(i, codes)]
            trie.insert(i, codes)
    least: dict[int, int] = {}
    for i in range(len(ids)):
        root = trie.find(i)
        least[root] = min(least.get(root, ids[i]), ids[i])
    touched = {x for link in out for x in link}
    stars = [(x, least[trie.find(i)]) for i, x in enumerate(ids) if x in touched and least[trie.find(i)] != x]
    return out, stars


def _link(percent: int, frequent):
    """Rows sorted by block: rep, shingles, label (null before the first round) after three block columns."""

    def run(batches):
        import pyarrow as pa

        block, ids, sets, labels = None, [], [], []

        def found():
            links, stars = link_block(ids, sets, percent, labels if labels[0] is not None else None, frequent.value) if len(ids) > 1 else ([], [])
            both = links + stars
            star = [False] * len(links) + [True] * len(stars)
            return [pa.RecordBatch.from_arrays([pa.array([a for a, _ in both], pa.int64()), pa.array([b for _, b in both], pa.int64()), pa.array(star)], ["a", "b", "star"])] if both else []

        for batch in batches:
            raw, at = utf8(batch.column(5))
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for i, (*key, rep, label) in enumerate(keys):
                if key != block:
                    if block is not None:
                        yield from found()
                    block, ids, sets, labels = key, [], [], []
                ids.append(rep)
                sets.append(np.frombuffer(raw[at[i] : at[i + 1]].tobytes(), np.uint64))
                labels.append(label)
        if block is not None:
            yield from found()

    return run


def _links_of(docs: DataFrame, dealt: DataFrame, width: int, percent: int, name: str, frequent) -> DataFrame:
    """Links and stars within the blocks of dealt (group, x, y, rep, label; materialised)."""
    reps = materialise(dealt.select("rep").distinct(), "reps")
    sets = map_arrow(semi_by_id(docs, "doc_id", reps), _sets(width), "rep long, shingles binary")
    rows = sets.join(fitting(dealt), "rep").select("group", "x", "y", "rep", "label", "shingles")
    rows = rows.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "rep")
    return materialise(map_arrow(rows, _link(percent, frequent), "a long, b long, star boolean"), name)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each two sets: rare elements by their pairs of sets, the others as products."""
    n = len(sets)
    tokens, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    code = code.reshape(-1)
    order = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(n), [len(s) for s in sets])[order]
    first = np.cumsum(times) - times
    out = np.zeros(n * n, np.int64)
    for c in range(2, RARE + 1):
        at = first[times == c]
        if len(at):
            own = owner[at[:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            out += np.bincount((own[:, i] * n + own[:, j]).reshape(-1), minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    often = np.flatnonzero(times > RARE)
    for lo in range(0, len(often), COLUMNS):
        part = often[lo : lo + COLUMNS]
        has = np.zeros((n, len(part)), np.float32)
        where = np.concatenate([np.arange(first[t], first[t] + times[t]) for t in part])
        has[owner[where], np.repeat(np.arange(len(part)), times[part])] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def count_links(ids: list[int], sets: list[np.ndarray], sides: list[int], lower: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(ids, links) of a cell: with how many of the other ids each links. Where there are two sides, pairs are of one from
    each; those that share a group of lower are counted there. An id that repeats links by any of its sets."""
    size, side = np.array([len(s) for s in sets]), np.array(sides)
    linked = (100 + percent) * _overlaps(sets) >= percent * (size[:, None] + size[None, :])
    if len(set(sides)) > 1:
        linked &= side[:, None] != side[None, :]
    if any(len(x) for x in lower):
        linked &= _overlaps(lower) == 0
    names, row = np.unique(np.array(ids, np.int64), return_inverse=True)
    if len(names) < len(ids):
        i, j = np.nonzero(linked)
        linked = np.zeros((len(names), len(names)), bool)
        linked[row[i], row[j]] = True
    else:
        linked = linked[np.argsort(ids)][:, np.argsort(ids)]
    np.fill_diagonal(linked, False)
    return names, linked.sum(axis=1)


def _count(percent: int):
    """Rows sorted by cell (group, x, y): rep, side, lower groups, shingles after the three columns."""

    def run(batches):
        import pyarrow as pa

        cell, held = None, []

        def told():
            ids, sides, lower, sets = zip(*held, strict=True)
            # A cell off the diagonal has pairs only if both of its sides do.
            if len(held) > 1 and (cell[1] == cell[2] or len(set(sides)) > 1):
                names, links = count_links(list(ids), list(sets), list(sides), list(lower), percent)
                fine = links > 0
                if fine.any():
                    yield pa.RecordBatch.from_arrays([pa.array(names[fine]), pa.array(links[fine].astype(np.int64))], ["rep", "links"])

        for batch in batches:
            raw, at = utf8(batch.column(6))
            for i, (*key, rep, side, lower) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                if key != cell:
                    if held:
                        yield from told()
                    cell, held = key, []
                held.append((rep, side, np.array(lower, np.int64), np.frombuffer(raw[at[i] : at[i + 1]].tobytes(), np.uint64)))
        if held:
            yield from told()

    return run


def _link_counts(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, n_links) of the classes that link: every two blocks of a group of members meet in one cell."""
    lists = members.groupBy("rep").agg(F.collect_list("group").alias("groups"))
    side = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")
    rows = members.select("group", "rep", "blocks", side.alias("side")).join(lists, "rep")
    rows = rows.withColumn("lower", F.filter("groups", lambda g: g < F.col("group"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "rep", "side", "lower")
    dealt = materialise(rows, "cells")
    reps = materialise(members.select("rep").distinct(), "reps")
    sets = map_arrow(semi_by_id(docs, "doc_id", reps), _sets(width), "rep long, shingles binary")
    cells = sets.where(F.length("shingles") > 0).join(fitting(dealt), "rep").select("group", "x", "y", "rep", "side", "lower", "shingles")
    cells = cells.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "rep")
    counted = map_arrow(cells, _count(percent), "rep long, links long")
    return materialise(counted.groupBy("rep").agg(F.sum("links").alias("n_links")), "link-counts")


def _salted(df: DataFrame, key: str = "rep") -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(key, F.lit(4)), F.lit(SALTS)).cast("int"))


def _by_group(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (group, salt, ...) joined with facts, one row a group: facts first go to the salts that a group has, so that
    a group's rows meet them in up to SALTS tasks. Only (group, salt) pairs meet by group alone."""
    return rows.join(rows.select("group", "salt").distinct().join(facts, "group"), ["group", "salt"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, window: int = WINDOW, frequent: int = FREQUENT, block: int = BLOCK, counts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of docs (doc_id, text). documents: one row per row of docs with doc_id, n_shingles,
    class_id (smallest doc_id of an equal set) and component_id (smallest doc_id reachable by links); links: pairs (a, b)
    of class ids that form a spanning forest of the components. counts: documents also have n_links, the exact number of
    other classes that theirs links with. Two documents link when their sets' Jaccard
    similarity is at least `percent` of 100. Null and empty texts, and texts without words, have an empty set and
    link with nothing; rows without a doc_id link with nothing and have no ids; rows that repeat a doc_id are one
    document, linked by any of its texts. An empty table gives empty results."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = materialise(map_arrow(docs, _survey(width, window), "doc_id long, n long, fp1 long, fp2 long, token long, times long"), "survey")
    sizes = survey.where("token is null").select("doc_id", "n", "fp1", "fp2")
    classes = materialise(sizes.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")

    top = survey.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"), F.min("doc_id").alias("group")).orderBy(F.desc("times"), "token").limit(frequent).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = np.empty(len(top), np.int64)
    rank[np.lexsort((tokens, top["times"].to_numpy(np.int64)))] = np.arange(len(top))
    sent = spark.sparkContext.broadcast((tokens[order], rank[order], top["group"].to_numpy(np.int64)[order]))

    leading = materialise_leading(docs, width, percent, sent)
    named = sizes.join(classes, ["n", "fp1", "fp2"]).select("doc_id", "rep", "n")
    grouped = materialise(_salted(leading.join(named, "doc_id").groupBy("group", "rep", "n").agg(F.max("times").alias("times"))), "grouped")
    # A set that links shares enough of its leading shingles with others: what shares fewer leaves.
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / EXTRA))
    alive = materialise(grouped.groupBy("group").agg(F.count("*").alias("members")).where("members > 1").select("group"), "alive")
    grouped = materialise(_by_group(grouped, alive), "grouped")
    enough = grouped.groupBy("rep").agg(F.sum("times").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= need).select("rep")
    grouped = grouped.join(enough, "rep")
    # Two sets that link meet in a group even if each leaves groups with fewer than half of what both need. A set leaves
    # those in which it shares least, such as those of a passage.
    least_first = Window.partitionBy("rep").orderBy("times", "group").rowsBetween(Window.unboundedPreceding, 0)
    grouped = grouped.withColumn("left", F.sum("times").over(least_first)).where(2 * F.col("left") > need - 1)
    grouped = materialise(grouped.select("group", "salt", "rep", "n"), "grouped")
    size = Window.partitionBy("group")
    totals = grouped.groupBy("group").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    totals = totals.where("members > 1").withColumn("blocks", F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    members = materialise(_by_group(grouped, totals.select("group", "blocks", "members")), "members")

    wide = members.where("blocks > 1")
    anchors = wide.withColumn("__nth", F.row_number().over(size.orderBy(F.xxhash64("rep"), "rep"))).where(F.col("__nth") <= ANCHORS)
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")
    shape = lambda df, x, y: df.select("group", x.alias("x"), y.alias("y"), "rep", F.lit(None).cast("long").alias("label"))
    first = shape(members, own, F.lit(-1)).unionByName(shape(anchors, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.lit(-1))).distinct()
    found = _links_of(docs, materialise(first, "blocks"), width, percent, "links", sent)
    links, edges = found.where("not star").drop("star"), found.where("star").drop("star")
    same = named.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b").select("a", "b")
    known = materialise(components(edges.unionByName(same)), "known")

    if not wide.isEmpty():
        label = F.coalesce("component", "rep")
        placed = wide.join(known, F.col("rep") == F.col("id"), "left").select("group", "salt", "blocks", "rep", "n", label.alias("label"))
        by_label = placed.groupBy("group", "label").agg(F.count("*").alias("size"))
        main = by_label.groupBy("group").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("parts"), (F.sum("size") - F.max("size")).alias("out"))
        placed = materialise(_by_group(placed, main.where("parts > 1")), "placed")
        if not placed.isEmpty():
            # Outliers (x blocks of them) meet every block y of their group.
            many = F.greatest(F.lit(1), F.ceil(F.col("out") / block)).cast("int")
            y = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")
            rows = placed.select("group", F.explode(F.sequence(F.lit(0), many - 1)).alias("x"), y.alias("y"), "rep", "label")
            meet = placed.where("label <> main").select("group", F.pmod(F.xxhash64("rep", F.lit(3)), many).cast("int").alias("x"), F.col("blocks"), "rep", "label")
            rows = rows.unionByName(meet.select("group", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "rep", "label"))
            more = _links_of(docs, materialise(rows.distinct(), "crossings"), width, percent, "more-links", sent)
            links = links.unionByName(more.where("not star").drop("star"))
            if not more.isEmpty():
                hung = known.select(F.col("id").alias("a"), F.col("component").alias("b"))
                known = components(hung.unionByName(more.drop("star")))
    counted = ["n_links"] if counts else []
    if counts:
        classes = classes.join(_link_counts(docs, members, width, percent), "rep", "left")
    reached = classes.join(known, F.col("rep") == F.col("id"), "left").select("n", "fp1", "fp2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), *counted)
    out = sizes.join(reached, ["n", "fp1", "fp2"], "left")
    named_id = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), named_id("class_id"), named_id("component_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counted)), links


def materialise_leading(docs: DataFrame, width: int, percent: int, sent) -> DataFrame:
    """(group, doc_id, times) of the documents that share leading shingles, of one pass over the texts."""
    dealt = map_arrow(docs, _leading(width, percent, sent), "token long, group long, doc_id long, times long")
    met = map_arrow(dealt.repartition("token").sortWithinPartitions("token", "doc_id"), _sharing, "group long, doc_id long, times long")
    return materialise(met.groupBy("group", "doc_id").agg(F.sum("times").alias("times")), "groups")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; all columns stay, and so do rows
    that link with nothing. Rows that repeat a doc_id stay together."""
    found = materialise(near_duplicates(docs, **how)[0], "near-duplicates")
    kept = found.where("doc_id is not null and component_id = doc_id").select("doc_id").distinct()
    return semi_by_id(docs, "doc_id", materialise(kept, "kept")).unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), counts=True)[0]
