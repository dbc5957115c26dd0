"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text is covered by vocabulary pieces in many ways.  Each piece has a weight; the probability of a
segmentation is proportional to the product of its pieces' weights.  Forward filtering sums, for every
position, the weights of all ways to reach it; backward sampling walks from the end, drawing each
piece in proportion to the sum that it leads back to.  The random numbers are hashes of the row key
and the position, so a row's sample depends on nothing else and reruns agree.

The model's scores are ranks of a merge table, so a piece weighs rank ** -ALPHA.  A character without
a piece is spelt with the model's byte pieces.  No piece has a blank after another character, so the
lattice of a text falls apart exactly at each blank that follows a word: the parts are filtered once
per batch however often they occur, and sampled anew at every occurrence.  Both work on whole arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from signalbook.llm.common import by_value

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
BLANK = 0x2581
#: Stands for a literal U+2581 in a text: outside Unicode, so no piece has it.
LITERAL_BLANK = 0x110001
KEY_SHIFT = 21
SLOT_BITS = 18
CHUNK_CHARS = 2_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(NamedTuple):
    """Trie of the pieces as a hash table in arrays, and the bytes of every id."""

    slot: np.ndarray  # of a hash of (node, character): where its keys begin, one more at the end
    keys: np.ndarray  # node << 21 | character, in the order of their hashes; one that is none at the end
    child: np.ndarray
    piece: np.ndarray  # id of the piece that ends at a node, or -1
    log_weight: np.ndarray  # by id
    spelling: list[bytes]
    first_byte: int  # id of the piece of byte 0
    parted: bool  # whether texts fall apart at blanks


def load(model_file: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """The vocabulary of a SentencePiece model with byte pieces.  Read on the driver only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
    is_byte = [model.is_byte(i) for i in range(size)]
    if sum(is_byte) != 256:
        raise ValueError("the model has no byte pieces, so not every text could be decoded")
    first_byte = names.index("<0x00>")
    nodes, piece = {}, [-1]
    parted = True
    for i, name in enumerate(names):
        if special[i] or is_byte[i]:
            continue
        parted &= not (chr(BLANK) in name[1:] and name.strip(chr(BLANK)))
        node = 0
        for character in name:
            key = node << KEY_SHIFT | ord(character)
            if key not in nodes:
                nodes[key] = len(piece)
                piece.append(-1)
            node = nodes[key]
        piece[node] = i
    keys = np.array(list(nodes), np.int64)
    hashed = _slot_of(keys)
    by_hash = np.argsort(hashed, kind="stable")
    slot = np.searchsorted(hashed[by_hash], np.arange(2**SLOT_BITS + 1)).astype(np.int32)
    child = np.array(list(nodes.values()), np.int64)[by_hash]
    rank = np.maximum(np.arange(size) - 256, 1)
    weight = -alpha * np.log(rank + 1.0)
    weight[is_byte] = -alpha * np.log(size + 1.0)
    spelling = [
        b"" if special[i] else bytes([int(n[3:5], 16)]) if is_byte[i] else n.replace(chr(BLANK), " ").encode()
        for i, n in enumerate(names)
    ]
    keys, child = np.append(keys[by_hash], -1), np.append(child, 0)
    return Vocabulary(slot, keys, child, np.array(piece, np.int64), weight, spelling, first_byte, parted)


def _slot_of(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * GOLDEN) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _find(voc: Vocabulary, key: np.ndarray) -> np.ndarray:
    """Where each key stands in the table, or -1."""
    slot = _slot_of(key)
    at, end = voc.slot[slot], voc.slot[slot + 1]
    found = np.where((voc.keys[at] == key) & (at < end), at, -1)
    open_ = np.flatnonzero((found < 0) & (at + 1 < end))
    while len(open_):
        at[open_] += 1
        hit = voc.keys[at[open_]] == key[open_]
        found[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit & (at[open_] + 1 < end[open_])]
    return found


def _utf8_length(character: np.ndarray) -> np.ndarray:
    return 1 + (character >= 0x80) + (character >= 0x800) + (character >= 0x10000)


class Lattice(NamedTuple):
    """Arcs of many parts, grouped by the node they end at, the longest first."""

    reach: np.ndarray  # log of the summed weight of all ways to a node
    first: np.ndarray  # of a node: its first arc, -1 for the first node of a part
    upto: np.ndarray  # of an arc: cumulative probability within its group, 1 for the last
    start: np.ndarray  # node at which the arc begins
    token: np.ndarray  # id, or -1 - character if it is spelt in several bytes
    final: np.ndarray  # last node of every part


def lattice(parts: list[str], voc: Vocabulary) -> Lattice:
    """Forward filtering of all parts at once, in the order of their lengths."""
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.where(text == BLANK, LITERAL_BLANK, np.where(text == 0x20, BLANK, text))
    part = np.repeat(np.arange(len(parts)), sizes)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    stop = (base + sizes)[part]
    at = np.arange(len(text))
    begin, node, end = at, np.zeros(len(text), np.int64), at
    starts, ends, tokens = [], [], []
    while len(begin):
        key = node << KEY_SHIFT | text[end]
        place = _find(voc, key)
        found = place >= 0
        begin, end, node = begin[found], end[found] + 1, voc.child[place[found]]
        whole = voc.piece[node] >= 0
        starts.append(begin[whole])
        ends.append(end[whole])
        tokens.append(voc.piece[node[whole]])
        more = end < stop[begin]
        begin, end, node = begin[more], end[more], node[more]
    single = np.zeros(len(text), bool)
    if starts:
        single[starts[0]] = True
    bare = np.flatnonzero(~single)
    character = np.where(text[bare] == LITERAL_BLANK, BLANK, text[bare])
    starts.append(bare)
    ends.append(bare + 1)
    tokens.append(np.where(character < 0x80, voc.first_byte + character, -1 - character))
    start, end, token = np.concatenate(starts), np.concatenate(ends), np.concatenate(tokens)
    spelt = token < 0
    weight = np.where(spelt, _utf8_length(-1 - token) * voc.log_weight[voc.first_byte], voc.log_weight[np.maximum(token, 0)])
    # A part of n characters has n + 1 nodes: shift positions by the number of the part.
    owner = part[start]
    depth = end - base[owner]
    start, end = start + owner, end + owner
    # Arcs were found in the order of their lengths: turned round, the likeliest mostly come first.
    sort = len(end) - 1 - np.argsort((depth * (len(text) + len(parts) + 1) + end)[::-1], kind="stable")
    start, end, token, weight, depth = start[sort], end[sort], token[sort], weight[sort], depth[sort]
    first = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(end))))
    reach = np.full(len(text) + len(parts), -np.inf)
    reach[base + np.arange(len(parts))] = 0.0
    first_arc = np.full(len(reach), -1, np.int64)
    first_arc[end[first]] = first
    share = np.zeros(len(end))
    levels = np.append(np.flatnonzero(np.append(True, depth[1:] != depth[:-1])), len(depth)) if len(depth) else []
    for a, b in zip(levels[:-1], levels[1:]):
        value = reach[start[a:b]] + weight[a:b]
        inner = first[group[a] : group[b - 1] + 1] - a
        mine = group[a:b] - group[a]
        top = np.maximum.reduceat(value, inner)
        raised = np.exp(value - top[mine])
        total = np.add.reduceat(raised, inner)
        reach[end[a:b][inner]] = top + np.log(total)
        share[a:b] = raised / total[mine]
    run = np.cumsum(share)
    upto = run - (run[first] - share[first])[group]
    if len(first):
        upto[np.append(first[1:], len(end)) - 1] = 1.0
    return Lattice(reach, first_arc, upto, start, token, base + sizes + np.arange(len(parts)))


def _uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from a mix of seed and counter."""
    z = seed + (counter.astype(np.uint64) + np.uint64(1)) * GOLDEN
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def sample(lat: Lattice, part: np.ndarray, seed: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of every occurrence: tokens in reading order and how many each has.

    part, seed and offset: of an occurrence its part, its row's seed and where in the row it ends.
    """
    node = lat.final[part]
    back = offset - node  # position in the row minus node: constant along the walk
    active = np.flatnonzero(lat.first[node] >= 0)
    steps, counts = [], np.zeros(len(part), np.int64)
    while len(active):
        now = node[active]
        u = _uniform(seed[active], (back[active] + now).astype(np.int64))
        arc = lat.first[now]
        past = np.flatnonzero(lat.upto[arc] <= u)
        while len(past):
            arc[past] += 1
            past = past[lat.upto[arc[past]] <= u[past]]
        steps.append((active, lat.token[arc]))
        counts[active] += 1
        node[active] = lat.start[arc]
        active = active[lat.first[node[active]] >= 0]
    out = np.zeros(int(counts.sum()), np.int64)
    last = np.cumsum(counts) - 1
    for step, (who, token) in enumerate(steps):
        out[last[who] - step] = token
    return out, counts


_PARTS = re.compile(r" *[^ ]+| +")


def encode_batch(texts: list[str], seeds: np.ndarray, voc: Vocabulary) -> list[np.ndarray]:
    """Sampled ids of every text.  An empty text has none."""
    cuts = [(_PARTS.findall(" " + text) if voc.parted else [" " + text]) if text else [] for text in texts]
    sizes = np.array([len(cut) for cut in cuts], np.int64)
    parts = list(chain.from_iterable(cuts))
    if not parts:
        return [np.zeros(0, np.int32) for _ in texts]
    number = dict(zip(dict.fromkeys(parts), count()))
    occurring = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    # Ends within the row: less what the rows before it hold.
    before = np.append(0, ends)[np.cumsum(sizes) - sizes]
    rows = np.repeat(np.arange(len(texts)), sizes)
    lat = lattice(list(number), voc)
    tokens, counts = sample(lat, occurring, seeds.view(np.uint64)[rows], ends - before[rows])
    spelt = tokens < 0
    per_row = np.bincount(rows, counts, minlength=len(texts)).astype(np.int64)
    if spelt.any():
        of_row = np.repeat(np.arange(len(texts)), per_row)
        length = np.where(spelt, _utf8_length(-1 - tokens), 1)
        per_row = np.bincount(of_row, length, minlength=len(texts)).astype(np.int64)
        bytes_of = {c: np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in np.unique(-1 - tokens[spelt]).tolist()}
        filled = np.repeat(tokens, length)
        begin = np.cumsum(length) - length
        for place in np.flatnonzero(spelt):
            spelling = bytes_of[int(-1 - tokens[place])]
            filled[begin[place] : begin[place] + len(spelling)] = voc.first_byte + spelling.astype(np.int64)
        tokens = filled
    return np.split(tokens.astype(np.int32), np.cumsum(per_row)[:-1])


def decode(ids: list[int], voc: Vocabulary) -> str:
    """The text of a sequence of ids, without the blank that encoding puts in front."""
    return b"".join(map(voc.spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _runs(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts = [text or "" for text in batch.column(name).to_pylist()]
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


def encode(
    docs: DataFrame,
    model_file: str = MODEL,
    alpha: float = ALPHA,
    seed: int = 0,
    ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_chars, n_pieces, pieces_sha256, lossless, and with ``ids`` pieces: one row per row.

    The row key is the id: rows that repeat an id and text get the same sample.  pieces_sha256 is
    taken over the ids as little-endian 32-bit integers; lossless says that decoding gave the text
    back.  A null text counts as empty and has no pieces.  Texts are encoded whole.
    """
    voc = load(model_file, alpha)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _runs(batch, "text"):
                seeds = part.column("seed").to_numpy(zero_copy_only=False).astype(np.int64)
                found = encode_batch(texts, seeds, voc)
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "n_pieces": pa.array([len(f) for f in found], pa.int64()),
                    "pieces_sha256": pa.array([hashlib.sha256(f.astype("<i4").tobytes()).hexdigest() for f in found]),
                    "lossless": pa.array([decode(f.tolist(), voc) == t for f, t in zip(found, texts)]),
                }
                if ids:
                    bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                    columns["pieces"] = pa.ListArray.from_arrays(bounds, np.concatenate(found))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, n_chars long, n_pieces long, pieces_sha256 string, lossless boolean" + ", pieces array<int>" * ids
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(seed))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("seed"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decoded(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """The rows of ``encoded`` with ``text`` decoded from ``pieces`` (null pieces as none)."""
    voc = load(model_file)
    kept = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode(ids or [], voc) for ids in batch.column("pieces").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("text", StringType())]))


by_value(__name__)
