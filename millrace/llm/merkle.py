"""Merkle fingerprints of documents: a tree of digests over leaves, paragraphs and sections.

A line is a paragraph. A section ends at a blank line and after every paragraph whose digest's last byte is a multiple
of SECTION. Leaves are short stretches of a paragraph that end where its own characters say so, at every length of text
by the same rule, so an edit changes the leaves around it and no others. A paragraph's digest is that of its leaves'
digests, a section's that of its paragraphs', the root that of the sections': equal roots are equal texts.

A fingerprint is text: the root, the level of its sample, and sections of paragraphs, each with its digest; a paragraph
also has its length and its sampled leaves. The sample is the SKETCH distinct leaves of least value, all leaves
of a text that has no more, so a comparison is exact on short texts and within some hundredths on long ones.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shuffle_partitions
from millrace.ship import ship

#: A section has about so many paragraphs, unless a blank line ends it.
SECTION = 16
#: A leaf has about MEAN code points, and never more than LONGEST; the last WINDOW ones say whether it ends.
MEAN, LONGEST, WINDOW = 14, 40, 4
#: So many distinct leaves are kept for comparison.
SKETCH = 512
#: Odd multipliers of a 32-bit hash of a window.
BASE, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: A leaf's value is its digest's first 25 bits, then its length in 7; the level of a sample that has all leaves.
LENGTH, ALL = 127, (1 << 32) - 1


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=b"branch").digest()


def _text(digest: bytes) -> str:
    return base64.urlsafe_b64encode(digest[:6]).decode()


class Leaves(dict):
    """Digest of a leaf's UTF-32 bytes; forgets all when it holds many."""

    def __missing__(self, data: bytes) -> bytes:
        if len(self) > 200_000:
            self.clear()
        self[data] = found = hashlib.blake2b(data, digest_size=16).digest()
        return found


_LEAVES = Leaves()


def leaf_ends(codes: np.ndarray, paragraphs: np.ndarray) -> np.ndarray:
    """Where the leaves of a text's code points end, given where its paragraphs end."""
    end = np.zeros(len(codes) + WINDOW, bool)
    if len(codes) >= WINDOW:
        hashed = codes[: len(codes) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            hashed *= BASE
            hashed += codes[k : len(codes) - WINDOW + 1 + k]
        hashed *= MIX
        end[WINDOW : len(codes) + 1] = hashed < np.uint32((1 << 32) // MEAN)
    for k in range(1, WINDOW):
        end[paragraphs + k] = False  # a window never reaches into the paragraph before
    end[paragraphs] = True
    ends = np.flatnonzero(end[: len(codes) + 1])
    sizes = np.diff(ends, prepend=0)
    for e, n in zip(ends[sizes > LONGEST].tolist(), sizes[sizes > LONGEST].tolist(), strict=True):
        end[range(e - n + LONGEST, e, LONGEST)] = True
    return np.flatnonzero(end[: len(codes) + 1])


@dataclass
class Paragraph:
    """digest; n: length in code points; sample: values of the leaves kept, in order, four bytes each."""

    digest: str
    n: int
    sample: bytes


@dataclass
class Section:
    digest: str
    paragraphs: list[Paragraph]


@dataclass
class Tree:
    root: str
    level: int
    sections: list[Section]

    @classmethod
    def of(cls, text: str) -> Tree:
        lines = text.splitlines(keepends=True)
        data = text.encode("utf-32-le", "surrogatepass")
        borders = np.cumsum([len(x) for x in lines], dtype=np.int64)
        ends = leaf_ends(np.frombuffer(data, np.uint32), borders)
        cuts = (4 * ends).tolist()
        own = [_LEAVES[data[a:b]] for a, b in zip([0, *cuts], cuts, strict=False)]
        values = np.frombuffer(b"".join(own), ">u4")[::4] & ~np.uint32(LENGTH) | np.diff(ends, prepend=0).astype(np.uint32)
        level = ALL
        if len(own) > SKETCH and len(distinct := np.unique(values)) > SKETCH:
            level = int(distinct[SKETCH - 1])
        kept = values <= level
        starts = (4 * np.concatenate([[0], np.cumsum(kept)])).tolist()
        sample = values[kept].astype(">u4").tobytes()
        sections: list[Section] = []
        now: list[Paragraph] = []
        below: list[bytes] = []
        above: list[bytes] = []
        at = 0
        for i, (line, to) in enumerate(zip(lines, (np.searchsorted(ends, borders) + 1).tolist(), strict=True), 1):
            digest = _digest(own[at:to])
            now.append(Paragraph(_text(digest), len(line), sample[starts[at] : starts[to]]))
            below.append(digest)
            at = to
            if i == len(lines) or digest[-1] % SECTION == 0 or not line.strip():
                above.append(_digest(below))
                sections.append(Section(_text(above[-1]), now))
                now, below = [], []
        return cls(_digest(above).hex(), level, sections)

    @classmethod
    def parse(cls, fingerprint: str) -> Tree:
        root, level, rest = fingerprint.split(":")
        sections = []
        for section in rest.split(";") if rest else []:
            digest, _, body = section.partition("/")
            paragraphs = [p.split(".") for p in body.split(",")]
            sections.append(Section(digest, [Paragraph(d, int(n), base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))) for d, n, s in paragraphs]))
        return cls(root, int(level, 16), sections)

    def __str__(self) -> str:
        def text(p: Paragraph) -> str:
            return f"{p.digest}.{p.n}.{base64.urlsafe_b64encode(p.sample).decode().rstrip('=')}"

        return f"{self.root}:{self.level:x}:" + ";".join(f"{s.digest}/{','.join(map(text, s.paragraphs))}" for s in self.sections)


Place = tuple[int, int, Paragraph]


def _differing(a: list, b: list) -> tuple[list, list]:
    """Of two lists of branches, last in their tuples, those without an equal one on the other side; repeats pair off one by one."""
    common = Counter(x[-1].digest for x in a) & Counter(x[-1].digest for x in b)
    out = []
    for side in (a, b):
        left, rest = common.copy(), []
        for x in side:
            if left[x[-1].digest]:
                left[x[-1].digest] -= 1
            else:
                rest.append(x)
        out.append(rest)
    return out[0], out[1]


def differing_paragraphs(a: Tree, b: Tree) -> tuple[list[Place], list[Place]]:
    """(section, paragraph, branch) of each tree below which the other has nothing equal, found from the root down."""
    if a.root == b.root:
        return [], []
    sides = _differing(list(enumerate(a.sections)), list(enumerate(b.sections)))
    x, y = ([(i, j, p) for i, s in side for j, p in enumerate(s.paragraphs)] for side in sides)
    return _differing(x, y)


def _length(leaves: Counter) -> int:
    return sum((v & LENGTH) * n for v, n in leaves.items())


def likeness(a: Tree, b: Tree) -> float:
    """Twice the length of the leaves that both have over that of all leaves: 1 for equal texts, 0 without a common leaf.

    Equal sections and paragraphs count whole; below those that differ, sampled leaves are matched, whatever their
    places, and stand for all leaves there.
    """
    if a.root == b.root:
        return 1.0
    x, y = differing_paragraphs(a, b)
    total = sum(p.n for t in (a, b) for s in t.sections for p in s.paragraphs)
    differing = sum(p.n for side in (x, y) for _, _, p in side)
    level = min(a.level, b.level)
    u, v = (Counter(v for v in np.frombuffer(b"".join(p.sample for _, _, p in side), ">u4").tolist() if v <= level) for side in (x, y))
    sampled = _length(u) + _length(v)
    share = 2 * _length(u & v) / sampled if sampled else 0.0
    return (total - differing + share * differing) / total


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of fingerprint a that b has nowhere, found from the root down."""
    return [(i, j) for i, j, _ in differing_paragraphs(Tree.parse(a), Tree.parse(b))[0]]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([str(Tree.of(t or "")) for t in batch.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row. A null text is empty; other columns are not read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint, f"id {rows.dtypes[0][1]}, fingerprint string").withColumnRenamed("id", id_col)


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is compared with the row after it, and a bucket's guest, its last row, is only compared with."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    before = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            out = []
            for bucket, guest, key, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                if guest and (before is None or before[0] != bucket):
                    continue  # a second guest of the same id, or the guest of an empty bucket
                tree = Tree.of(text)
                if before is not None and before[0] == bucket:
                    _, own_key, own, own_tree = before
                    n = len(own) // 4
                    edited = own[: len(own) - n] + text[:n]
                    edited_tree = Tree.of(edited)
                    out.append((own_key, len(own), hashlib.sha256(edited.encode()).hexdigest(), str(own_tree), str(edited_tree), likeness(own_tree, edited_tree), likeness(own_tree, tree)))
                before = None if guest else (bucket, key, text, tree)
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [part.schema.field("id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each row against its own edited text and against the next row in ascending (id, text), the last against the first.

    The edited text has the last quarter (rounded down) of its code points replaced by as many first ones of the next
    row's, or all of them. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text is empty, null ids come first, repeated rows follow each other, a lone row follows itself, an empty
    table gives none. Ids are numbers; others are refused, as ranges are cut by approximate quantiles of them. Texts move once, into ranges of ids whose lower ends are ids of the table; the first row of a
    range is also the guest of the range before, which gives its last row a next one.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if rows.dtypes[0][1].split("(")[0] not in {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"}:
        raise TypeError(f"ids of {id_col} must be numbers, not {rows.dtypes[0][1]}")
    buckets = buckets or 4 * shuffle_partitions(spark)
    ends = rows.agg(F.percentile_approx("id", [i / buckets for i in range(buckets)], 20 * buckets), F.min("id"), F.count("*"), F.count("id")).first()
    if not ends[2]:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {rows.dtypes[0][1]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    first_null = ends[2] > ends[3]
    lower = sorted({ends[1], *ends[0]}) if ends[3] else []
    starts = ([None] if first_null else []) + lower  # of the buckets, in order
    kind = rows.dtypes[0][1]
    width = max(1, math.isqrt(len(lower)))  # a bucket is looked up among every width-th bound, then between two of these
    every, some = ([F.lit(x).cast(kind) for x in b] for b in (lower, lower[::width]))
    bounds, coarse = (F.array(*b) if b else F.array().cast(f"array<{kind}>") for b in (every, some))
    far = F.size(F.filter(coarse, lambda b: b <= F.col("id"))) - 1
    near = F.size(F.filter(F.slice(bounds, far * width + 1, width), lambda b: b <= F.col("id"))) - 1
    at = (far * width + near).cast("int")
    own = F.when(F.col("id").isNull(), 0).otherwise(at + int(first_null)).cast("int")
    opens = F.when(F.col("id").isNull(), first_null).otherwise(F.coalesce(F.get(bounds, at) == F.col("id"), F.lit(False)))
    before = F.when(F.col("bucket") == 0, len(starts) - 1).otherwise(F.col("bucket") - 1).cast("int")
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), *[F.when(opens, F.struct(before.alias("bucket"), F.lit(True).alias("guest")))])
    placed = rows.withColumn("bucket", own).withColumn("place", F.explode(places)).filter("place is not null")
    dealt = placed.select("place.bucket", "place.guest", "id", "text").repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_against_next, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
