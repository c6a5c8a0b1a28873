"""Fill-in-middle transformation: a text is cut in three, and its middle moved behind the rest.

A whole batch is cut at once on its Arrow buffers. Bytes are looked up in a table of classes; a table of pairs of classes
says between which neighbours a unit may begin; sums of these beginnings, taken anew from each text's first byte, number
the units; a binary search in the sums gives the byte of each wanted unit. The parts of all texts are one Arrow array
over the same bytes, with the cuts as its offsets.

A unit is a code point (``units="chars"``) or a run of letters and digits, of white space or of signs (``"words"``; all
characters beyond ASCII count as letters). Two numbers from a hash of the id choose the cuts among all n + 1 places, two
more the form: prefix, suffix, middle (psm), suffix, prefix, middle (spm) or plain.

Defined cases: a null text is an empty one; an empty text, and one that holds a sentinel, stay plain; a null id counts
as empty text in the hash; rows of the same id are cut alike where their texts are; repeated rows are kept; an empty
table gives no rows; texts are cut whole, whatever their length (one beyond ``CHUNK`` is a batch of its own); kept
columns with the name of a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import plain_names, settle
from glyphmill.llm.runs import pieces_of

SENTINELS = ("<P>", "<S>", "<M>")
#: Per hundred texts: those that stay plain, and those of the others with the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Bytes of text of a batch.
CHUNK = 1 << 20
RESULTS = ("n", "form", "prefix_units", "middle_units", "output")
_LETTER, _SPACE, _SIGN, _LEAD, _INNER = range(5)


def byte_classes() -> np.ndarray:
    """By byte of UTF-8: letter or digit, white space, sign, first byte of a longer character, inner byte of one."""
    out = np.full(256, _SIGN, np.uint8)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        out[ord(low) : ord(high) + 1] = _LETTER
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[128:192], out[192:] = _INNER, _LEAD
    return out


def begins(units: str) -> np.ndarray:
    """By the classes of two neighbouring bytes: whether a unit may begin with the second."""
    out = np.ones((5, 5), bool)
    out[:, _INNER] = False
    if units == "words":
        for same in ((_LETTER, _LEAD, _INNER), (_SPACE,), (_SIGN,)):
            out[np.ix_(same, same)] = False
    elif units != "chars":
        raise ValueError("units are chars or words")
    return out


def checked(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """Sentinels that can be found again: different, and their first character stands nowhere else in any of them."""
    if len(set(sentinels)) < 3 or any(not s or any(s[0] in t[1:] for t in sentinels) for s in sentinels):
        raise ValueError("three different sentinels whose first characters occur in them once")
    return tuple(s.encode() for s in sentinels)  # type: ignore[return-value]


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large binaries without nulls, and where each one begins and the last one ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def of_spans(body: np.ndarray, at: np.ndarray) -> pa.Array:
    """Parts of the bytes that follow each other, without copying them."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(body)])


class Units:
    """The units of all texts of a batch."""

    def __init__(self, body: np.ndarray, at: np.ndarray, units: str = "chars"):
        starts = np.ones(len(body), bool)
        kind = byte_classes()[body]
        starts[1:] = begins(units)[kind[:-1], kind[1:]]
        starts[at[:-1][at[:-1] < at[1:]]] = True  # a text's first byte begins a unit, whatever stood before it
        self.total = np.cumsum(starts, dtype=np.int32 if len(body) < 1 << 31 else np.int64)
        self.before = np.where(at > 0, self.total[at - 1] if len(body) else 0, 0).astype(np.int64)
        self.n = np.diff(self.before)

    def byte_of(self, k: np.ndarray) -> np.ndarray:
        """The byte at which unit k (from 0) of each text begins; its n-th one is the text's end."""
        return np.searchsorted(self.total, self.before[:-1] + k + 1, side="left").astype(np.int64)


def texts_of(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def cut(texts: pa.Array, h: list[np.ndarray], sentinels: tuple[bytes, bytes, bytes], plain_share: int, spm_share: int, units: str) -> dict[str, pa.Array]:
    """The results of a batch; h: the four numbers of each row."""
    body, at = spans(texts)
    found = Units(body, at, units)
    first, last = np.minimum(h[0] % (found.n + 1), h[1] % (found.n + 1)), np.maximum(h[0] % (found.n + 1), h[1] % (found.n + 1))
    a, b = found.byte_of(first), found.byte_of(last)
    parts = of_spans(body, np.append(np.stack([at[:-1], a, b], 1).ravel(), at[-1]))
    rows = np.arange(len(texts)) * 3
    prefix, middle, suffix = (parts.take(pa.array(rows + k)) for k in range(3))
    held = np.zeros(len(texts), bool)
    for s in sentinels:
        held |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    plain = held | (found.n == 0) | (h[2] % 100 >= 100 - plain_share)
    spm = ~plain & (h[3] % 100 < spm_share)
    turned, kept = pa.array(spm), pa.array(plain)
    p, s, m = (pa.scalar(x, pa.large_binary()) for x in sentinels)
    pick = pc.if_else
    moved = pc.binary_join_element_wise(pick(turned, s, p), pick(turned, suffix, prefix), pick(turned, p, s), pick(turned, prefix, suffix), m, middle, pa.scalar(b"", pa.large_binary()))
    null = pa.scalar(None, pa.int64())
    return {
        "n": pa.array(found.n),
        "form": pc.if_else(kept, "plain", pc.if_else(turned, "spm", "psm")),
        "prefix_units": pick(kept, null, pa.array(first.astype(np.int64))),
        "middle_units": pick(kept, null, pa.array((last - first).astype(np.int64))),
        "output": pick(kept, texts, moved).cast(pa.large_string()).cast(pa.string()),
    }


def joined(outputs: pa.Array, forms: pa.Array, sentinels: tuple[bytes, bytes, bytes]) -> pa.Array:
    """The texts of a batch, from outputs and forms alone."""
    p, s, m = sentinels
    plain, turned = pc.equal(forms, "plain"), pc.equal(forms, "spm")
    body, at = spans(pc.if_else(plain, pa.scalar(b"", pa.large_binary()), outputs))
    moved = of_spans(body, at)
    place = {x: pc.find_substring(moved, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (p, s, m)}
    spm, none = turned.to_numpy(zero_copy_only=False), plain.to_numpy(zero_copy_only=False)
    second = np.where(none, 0, np.where(spm, place[p], place[s]))
    third = np.where(none, 0, place[m])
    size = [np.where(none, 0, x) for x in (np.where(spm, len(s), len(p)), np.where(spm, len(p), len(s)), len(m))]
    start = at[:-1]
    cuts = np.stack([start, start + size[0], start + second, start + second + size[1], start + third, start + third + size[2]], 1)
    parts = of_spans(body, np.append(cuts.ravel(), at[-1]))
    rows = np.arange(len(outputs)) * 6
    one, two, middle = (parts.take(pa.array(rows + k)) for k in (1, 3, 5))
    whole = pc.binary_join_element_wise(pc.if_else(turned, two, one), middle, pc.if_else(turned, one, two), pa.scalar(b"", pa.large_binary()))
    return pc.if_else(plain, outputs, whole)


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers from the first 8-digit groups of the hex sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k}") for k in range(4)]


def _schema(df: DataFrame, names: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def fill_in_middle(df: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE, units: str = "chars") -> DataFrame:
    """Adds n, form, prefix_units, middle_units and output to the columns ``keep`` (default: all); no shuffle."""
    marks, _ = checked(sentinels), begins(units)
    keep = plain_names(df, df.columns if keep is None else keep, RESULTS)
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], *draws(key, seed), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for piece in pieces_of(batch, batch.num_columns - 1, CHUNK):
                columns = piece.columns
                h = [c.to_numpy(zero_copy_only=False) for c in columns[-5:-1]]
                got = cut(texts_of(columns[-1]), h, marks, plain_share, spm_share, units)
                yield pa.RecordBatch.from_arrays([*columns[: len(keep)], *(got[n] for n in RESULTS)], names=[*keep, *RESULTS])

    kept = _schema(chosen, keep)
    return chosen.mapInArrow(run, f"{kept}{', ' if keep else ''}n long, form string, prefix_units long, middle_units long, output string")


def restored(df: DataFrame, *, output: str = "output", form: str = "form", name: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Adds the text rebuilt from output and form. A null output gives an empty text; a null form counts as plain."""
    marks = checked(sentinels)
    keep = plain_names(df, df.columns, [name])
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{form}`"), F.lit("plain")).alias("__form"), F.col(f"`{output}`").cast("string").alias("__output"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, batch.num_columns - 1, CHUNK):
                columns = piece.columns
                text = joined(texts_of(columns[-1]), columns[-2], marks).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns[:-2], text], names=[*keep, name])

    kept = _schema(chosen, keep)
    return chosen.mapInArrow(run, f"{kept}{', ' if keep else ''}`{name}` string")
