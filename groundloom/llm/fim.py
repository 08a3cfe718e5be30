"""Fill-in-the-middle transformation on ropes.

A text is cut into units (``[A-Za-z]+|[^A-Za-z]``, left to right over code points). Its rope is a balanced tree whose leaves are
slices of the UTF-8 bytes that begin and end between units; leaves and nodes cache how many units and code points they hold. The
tree is split at two unit ranks, and the three parts are joined in another order with sentinels as leaves of
their own: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle. A split goes down one path, so it
touches logarithmically many nodes, and one leaf is cut.

The inverse makes a rope of the output, splits it before and behind each sentinel and joins prefix, middle and suffix. No
sentinel can arise where parts meet (none begins with the end of another), and texts that hold one stay plain.

Unit starts of a whole block of texts are found in one vectorised pass over its bytes (blocks of ``common.CHUNK_BYTES``, a longer
text alone), so memory doesn't grow with the table.

Cases: a null text counts as empty; empty texts are plain with n 0. A null id counts as the empty text in its hash. Repeated rows of an
id are cut alike. Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Units of a leaf.
LEAF = 128
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of texts that are rearranged, and of those, per cent that put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
_UNIT = re.compile(rb"[A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True


@dataclass(frozen=True, slots=True)
class Leaf:
    data: bytes
    units: int
    chars: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    chars: int


Rope = Leaf | Node
EMPTY = Leaf(b"", 0, 0)


def joined(a: Rope, b: Rope) -> Rope:
    if not a.units or not b.units:
        return a if a.units else b
    return Node(a, b, a.units + b.units, a.chars + b.chars)


def balanced(parts: list[Rope]) -> Rope:
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the others."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.units:
        return rope, EMPTY
    if isinstance(rope, Leaf):
        for k, m in enumerate(_UNIT.finditer(rope.data)):
            if k == rank:
                break
        head = rope.data[: m.start()]
        chars = len(head.decode("utf-8", "replace"))
        return Leaf(head, rank, chars), Leaf(rope.data[m.start() :], rope.units - rank, rope.chars - chars)
    if rank < rope.left.units:
        a, b = split(rope.left, rank)
        return a, joined(b, rope.right)
    a, b = split(rope.right, rank - rope.left.units)
    return joined(rope.left, a), b


def leaves(rope: Rope) -> Iterator[Leaf]:
    held = [rope]
    while held:
        top = held.pop()
        if isinstance(top, Leaf):
            yield top
        else:
            held += [top.right, top.left]


def text_of(rope: Rope) -> bytes:
    return b"".join(leaf.data for leaf in leaves(rope))


def unit_starts(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Each text with the byte positions of its units and the number of code points before each of them."""
    for lo, hi in chunks(texts):
        block = texts[lo:hi]
        data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
        letter = _LETTER[data]
        begins = ~_INNER[data]
        start = begins & ~(letter & np.concatenate(([False], letter[:-1])))
        at = np.flatnonzero(start)
        chars = (np.cumsum(begins) - begins)[at]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in block), np.int64, len(block)))
        begin = np.concatenate(([0], ends[:-1]))
        # a line feed parts the texts and is one unit of one code point: it is left out
        first, last = np.searchsorted(at, begin), np.searchsorted(at, ends - 1)
        for t, b, i, j in zip(block, begin, first, last):
            yield t, at[i:j] - b, chars[i : j + 1] - chars[i]


def rope_of(text: bytes, at: np.ndarray, chars: np.ndarray) -> Rope:
    """From unit positions and code points before each unit (with one entry more for the end)."""
    n = len(at)
    cuts = [*range(0, n, LEAF), n]
    place = [*at[cuts[:-1]].tolist(), len(text)]
    count = chars[cuts].tolist()
    return balanced([Leaf(text[place[i] : place[i + 1]], cuts[i + 1] - cuts[i], count[i + 1] - count[i]) for i in range(len(cuts) - 1)] if n else [])


_SENTINELS = {s: Leaf(s, 3, 3) for s in (PREFIX, SUFFIX, MIDDLE)}


def rearranged(rope: Rope, low: int, high: int, form: str) -> tuple[Rope, Rope, Rope]:
    """(the output, prefix, middle) of a rope that is cut at two unit ranks."""
    rest, suffix = split(rope, high)
    prefix, middle = split(rest, low)
    first = [_SENTINELS[PREFIX], prefix]
    second = [_SENTINELS[SUFFIX], suffix]
    order = [*first, *second] if form == "psm" else [*second, *first]
    return balanced([*order, _SENTINELS[MIDDLE], middle]), prefix, middle


def inverted(rope: Rope, starts: list[int], form: str) -> Rope:
    """The text's rope from that of the output; ``starts`` are the unit ranks of the two inner sentinels."""
    head, last = split(rope, starts[1])
    one, two = split(head, starts[0])
    part = lambda x: split(x, 3)[1]  # noqa: E731  without its sentinel
    prefix, suffix = (part(one), part(two)) if form == "psm" else (part(two), part(one))
    return joined(joined(prefix, part(last)), suffix)


def draws(row: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits of the hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _bytes(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.view(kind).to_pylist()]


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _bytes(batch.column("text"))
        draw = [batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5)]
        sizes, forms, outputs, heads, middles = [], [], [], [], []
        for i, (text, at, chars) in enumerate(unit_starts(texts)):
            n = len(at)
            h1, h2, h3, h4 = (int(d[i]) for d in draw)
            sizes.append(n)
            if not text or any(s in text for s in _SENTINELS) or h3 % 100 >= RATE:
                forms.append("plain")
                outputs.append(text)
                heads.append(None)
                middles.append(None)
                continue
            form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
            out, prefix, middle = rearranged(rope_of(text, at, chars), *sorted((h1 % (n + 1), h2 % (n + 1))), form)
            forms.append(form)
            outputs.append(text_of(out))
            heads.append(prefix.chars)
            middles.append(middle.chars)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), _strings(outputs)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    drawn = docs.select("doc_id", "text", *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)))
    return drawn.mapInArrow(_transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        outputs, forms = _bytes(batch.column("output")), batch.column("form").to_pylist()
        back = []
        for form, (text, at, chars) in zip(forms, unit_starts(outputs)):
            if form == "plain":
                back.append(text)
                continue
            inner = (SUFFIX if form == "psm" else PREFIX, MIDDLE)
            starts = [int(np.searchsorted(at, text.index(s, 3))) for s in inner]
            back.append(text_of(inverted(rope_of(text, at, chars), starts, form)))
        yield pa.RecordBatch.from_arrays([*batch.columns, _strings(back)], names=[*batch.schema.names, "restored"])


def restored(outputs: DataFrame) -> DataFrame:
    """Adds ``restored``: the text, made from the columns output and form alone."""
    from pyspark.sql.types import StringType, StructField, StructType

    return outputs.mapInArrow(_restore, StructType([*outputs.schema.fields, StructField("restored", StringType())]))
