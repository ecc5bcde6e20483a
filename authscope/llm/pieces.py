"""Sampled segmentations into SentencePiece pieces, and lossless decoding."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.llm.text import draws, mix, slices, text_buffer

SPACE = "▁"
SEED = 5
#: Units whose lattice is kept by a worker.
KEPT = 200_000
#: Edges that a worker keeps, of some 20 bytes; a slice of text may add as many as it has.
KEPT_EDGES = 4_000_000
#: Characters of new units whose lattices are built at once.
GROUP_CHARS = 100_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model, their chances, and the bytes they stand for.

    The model ranks its pieces and has no chances, so a piece of rank r gets a share in
    proportion to 1 / (r + 1), raised to ``alpha``: below 1 the samples vary more.
    """

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        ranks: dict[int, float] = {}
        pieces: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                ranks[i] = min(-model.get_score(i), float(size))
        total = sum(1 / (r + 1) for r in ranks.values())
        #: Chance of falling back to the bytes of a character that no piece holds.
        self.rare = (1 / (size * total)) ** alpha
        #: Id and chance by piece.
        self.known = {p: (i, (1 / ((ranks[i] + 1) * total)) ** alpha) for p, i in pieces.items()}
        self.longest = max(map(len, pieces))
        # A trie of the pieces: its branches as sorted numbers (node, character), where each leads
        # to, and for each node the id and chance of the piece that ends there.
        nodes = {"": 0}
        branches: dict[int, int] = {}
        for piece in pieces:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    branches[nodes[piece[: n - 1]] << 21 | ord(piece[n - 1])] = nodes[piece[:n]]
        self.branch = np.array(sorted(branches), np.int64)
        self.child = np.array([branches[k] for k in self.branch.tolist()], np.int64)
        self.ends = np.full(len(nodes), -1, np.int32)
        self.chance = np.zeros(len(nodes))
        for piece, (i, chance) in self.known.items():
            self.ends[nodes[piece]], self.chance[nodes[piece]] = i, chance
        # Units end before a space or a line feed: no piece may hold one of these further on.
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of this model goes across words or lines")
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where each id's ones begin."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[at], np.concatenate([[0], ends])


class Lattices(dict):
    """Forward-filtered lattices of units, as one table of edges.

    A unit is a run of spaces with the word behind it, or a line feed with the word behind it,
    and no piece crosses its border; so a text's lattice is those of its units in a row. The
    key of a unit is its text, less one space if it begins with spaces. Edges lie by the node
    that they lead to, each with the chance of having come by it or an earlier edge of the node.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.last = np.zeros(0, np.int64)
        self.edges = [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        self.begin = np.zeros(0, np.int64)  # number of each node's first edge
        self.fresh: list[str] = []
        self.nodes = 0

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.fresh.append(unit if unit.startswith("\n") else " " + unit)
        return n

    def settle(self) -> None:
        """Put in the edges of the units met since the last time, some at once."""
        parts, lasts, i = [self.edges], [self.last], 0
        while i < len(self.fresh):
            j, chars = i, 0
            while j < len(self.fresh) and (j == i or chars + len(self.fresh[j]) <= GROUP_CHARS):
                chars += len(self.fresh[j])
                j += 1
            last, edges = self._build(self.fresh[i:j])
            lasts.append(last)
            parts.append(edges)
            i = j
        self.fresh = []
        self.last = np.concatenate(lasts)
        before, size = len(self.begin), len(self.edges[0])
        self.edges = [np.concatenate(c) for c in zip(*parts)]
        new = np.searchsorted(self.edges[0][size:], np.arange(before, self.nodes), "right") + size
        self.begin = np.concatenate([self.begin, new])

    def _pieces_at(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance (0 if there is none) and id of the piece of each length at each place."""
        v = self.vocabulary
        chance = np.zeros((len(codes), v.longest))
        ids = np.full((len(codes), v.longest), -1, np.int32)
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for n in range(v.longest):
            inside = left[at] > n
            at, state = at[inside], state[inside]
            branch = state << 21 | codes[at + n]
            found = np.minimum(np.searchsorted(v.branch, branch), len(v.branch) - 1)
            on = v.branch[found] == branch
            at, state = at[on], v.child[found[on]]
            if not len(at):
                break
            ends = v.ends[state] >= 0
            chance[at[ends], n], ids[at[ends], n] = v.chance[state[ends]], v.ends[state[ends]]
        none = np.flatnonzero(chance[:, 0] == 0)
        chance[none, 0] = v.rare
        return chance, ids

    def _build(self, units: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Last nodes and edges of some units; one step forward is made in all of them at once."""
        v, raw = self.vocabulary, "".join(units)
        # Spaces are written with the mark; a mark in the text itself must come back as bytes.
        shown = raw.replace(SPACE, "\0").replace(" ", SPACE)
        codes = np.frombuffer(shown.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(sizes)
        chars, count = len(codes), len(units)
        chance, ids = self._pieces_at(codes, np.repeat(ends, sizes) - np.arange(chars))
        plain = (ids[:, 0] < 0) & (codes > 0) & (codes < 128)
        ids[plain, 0] = np.array(v.byte_ids, np.int32)[codes[plain]]

        # Node r of unit u stands before character r - u; a unit has one node more than characters.
        order = np.argsort(-sizes, kind="stable")
        start, length = (ends - sizes)[order], sizes[order]
        first = start + order
        ahead = np.zeros(chars + count)
        ahead[first] = 1.0
        share = np.zeros((chars + count, v.longest))
        for t in range(1, int(length[0]) + 1):
            n = int(np.searchsorted(-length, -t, "right"))
            back = np.arange(min(v.longest, t))
            node = first[:n] + t
            mass = ahead[(node - 1)[:, None] - back] * chance[(start[:n] + t - 1)[:, None] - back, back]
            total = mass.sum(axis=1)
            ahead[node] = total
            share[node, : len(back)] = mass / total[:, None]
            if t % 8 == 0:  # only ratios count, so keep what is still in use away from 0
                ahead[node[:, None] - np.arange(min(v.longest, t) + 1)] /= total[:, None]

        node, back = np.nonzero(share)
        cumulative = np.cumsum(share, axis=1)[node, back]
        final = np.append(node[1:] != node[:-1], True)
        cumulative[final] = 1.0
        unit = np.repeat(np.arange(count), sizes + 1)[node]
        at = node - unit - 1 - back
        piece, base = ids[at, back], self.nodes
        cumulative, previous = base + node + cumulative, base + node - 1 - back
        # The bytes of a character without a piece: a path of sure edges over nodes of their own.
        free, extra = base + chars + count, []
        for e in np.flatnonzero(piece < 0).tolist():
            *before, last = (v.byte_ids[b] for b in raw[at[e]].encode())
            for b in before:
                extra.append((free + 1.0, int(previous[e]), b))
                previous[e] = free
                free += 1
            piece[e] = last
        self.nodes = free
        # A unit's first node has one edge, and that leads nowhere: it marks the end of a sample.
        heads = base + np.sort(first)
        more = list(zip(*extra)) or [[], [], []]
        edges = [
            np.concatenate([cumulative, heads + 1.0, np.array(more[0], np.float64)]),
            np.concatenate([previous, np.full(count, -1), np.array(more[1], np.int64)]),
            np.concatenate([piece, np.full(count, -1, np.int32), np.array(more[2], np.int32)]),
        ]
        by_node = np.argsort(edges[0], kind="stable")
        return base + ends + np.arange(count), [c[by_node] for c in edges]

    def sample(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one sampled path through each unit, and where each unit's ones begin.

        Backward sampling: from the last node, an edge is drawn by its chance, and so on from
        the node where it began. All units go side by side. A unit's draws follow from its key.
        """
        cumulative, previous, piece = self.edges
        node = self.last[units]
        who = np.arange(len(units))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            drawn = node + draws(keys[who] + np.uint64(len(steps)), SEED)
            at, short = self.begin[node], np.arange(len(node))
            while len(short := short[cumulative[at[short]] < drawn[short]]):
                at[short] += 1
            steps.append((who, piece[at]))
            node = previous[at]
            # the first node of a unit has one edge, and that leads nowhere
            on = previous[self.begin[node]] >= 0
            who, node = who[on], node[on]
        count = np.zeros(len(units), np.int64)
        for w, _ in steps:
            count[w] += 1
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for n, (w, p) in enumerate(steps):
            ids[ends[w] - 1 - n] = p
        return ids, np.concatenate([[0], ends])


_UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*")


def units_of(text: str) -> list[str]:
    """Keys of the units of a text with a space before it."""
    if not text:
        return []
    if "  " in text or text.startswith(" "):
        return [u if u[0] == "\n" else u[1:] for u in _UNIT.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def encode(texts: list[str], keys: np.ndarray, lattices: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts, and where each text's ones begin."""
    if len(lattices) > KEPT or len(lattices.edges[0]) > KEPT_EDGES:
        lattices.forget()
    parts = [units_of(t) for t in texts]
    units = np.fromiter(map(lattices.__getitem__, chain.from_iterable(parts)), np.int64)
    lattices.settle()
    sizes = np.array([len(p) for p in parts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(units)) - np.repeat(first[:-1], sizes)
    own = mix(np.repeat(mix(keys.astype(np.uint64)), sizes) + place.astype(np.uint64))
    ids, begin = lattices.sample(units, own)
    return ids, begin[first]


_LATTICES: dict[tuple[str, float], Lattices] = {}


def _lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattices(Vocabulary(path, alpha))
    return _LATTICES[path, alpha]


def _encoded(batches, path: str, alpha: float):
    lattices = _lattices(path, alpha)
    vocabulary = lattices.vocabulary
    for piece in slices(batches, limit=1 << 20):
        texts = [t or "" for t in piece.column("text").to_pylist()]
        keys = piece.column("key").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        ids, first = encode(texts, keys, lattices)
        flat, at = vocabulary.decode_bytes(ids)
        begin = at[first]
        data, offsets = text_buffer(piece.column("text").fill_null(""))
        whole = np.diff(begin) == np.diff(offsets) + (np.diff(offsets) > 0)
        same = [bool(w) and (a == b or flat[a + 1 : b].tobytes() == data[c:d].tobytes()) for w, a, b, c, d in zip(whole, begin, begin[1:], offsets, offsets[1:])]
        columns = [piece.column("key"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids", "lossless"])


def sample_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 1.0, path: str | None = None) -> DataFrame:
    """A row (key, n_tokens, ids, lossless) for each row of ``docs``: one sampled segmentation.

    Ids are drawn from all segmentations of the text by forward filtering and backward
    sampling; the draws depend on the row's key and the place in the text, so a row gets the
    same ids in every run and partitioning. ``lossless`` tells whether decoding the ids gave
    the text back. Characters without a piece, and the space mark itself, are written as bytes.

    A null or empty text has no ids. Equal keys with equal texts give equal ids; null keys
    share their draws. No rows give no rows. Only the key and the text are read.
    """
    path = path or model_path()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids array<int>, lossless boolean"
    return rows.mapInArrow(lambda b: _encoded(b, path, alpha), schema).withColumnRenamed("key", key)


def decode_pieces(ids: Column, path: str | None = None) -> Column:
    """The text that ids stand for; null ids give null."""
    path = path or model_path()

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        table = _lattices(path, 1.0).vocabulary.bytes
        return pa.array([None if i is None else b"".join(map(table.__getitem__, i)).decode(errors="replace")[1:] for i in lists.to_pylist()], pa.string())

    return decode(ids)
