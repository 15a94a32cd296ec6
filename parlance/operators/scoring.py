"""Diarization error rates, Jaccard error rates and their breakdown, a meeting at a time.

Segments (meeting_id, side R or H, label, lo, hi in whole microseconds) are grouped by meeting
in one shuffle. A meeting's group is swept once in numpy: its boundaries, collars and
scoring region cut time into cells, and every figure is a sum over cells. A group holds one
meeting's segments and a byte for each label and cell, so an hour of 20 speakers and 5,000
turns takes about half a megabyte; there is no bound but the length of a meeting.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count, product
from math import lcm
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPEAKER = "struct<speaker:string,mapped_to:string,total:bigint,correct:bigint,miss:double,conf:double,fa:double,jer:double>"
SCORES = (
    "meeting_id long, total long, miss long, fa long, conf long, correct long, overlap_time long, overlap_total long, overlap_miss long,"
    f" overlap_fa long, overlap_conf long, overlap_correct long, n_ref long, jer double, mapping array<struct<ref:string,hyp:string,shared:bigint>>, speakers array<{SPEAKER}>"
)


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), each used once, of the largest total gain.

    Shortest augmenting paths with potentials (Kuhn and Munkres; Jonker and Volgenant). Of
    equally near columns a free one of the smallest number is taken.
    """
    rows, columns = gain.shape
    if rows > columns:
        return sorted((r, c) for c, r in assignment(gain.T))
    u, v = np.zeros(rows + 1), np.zeros(columns + 1)
    owner, way = np.zeros(columns + 1, int), np.zeros(columns + 1, int)
    for i in range(1, rows + 1):
        owner[0], j = i, 0
        least, used = np.full(columns + 1, np.inf), np.zeros(columns + 1, bool)
        while owner[j]:
            used[j] = True
            spare = -gain[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~used[1:] & (spare < least[1:])
            least[1:][better] = spare[better]
            way[1:][better] = j
            free = np.where(used[1:], np.inf, least[1:])
            ties = np.flatnonzero(free == free.min()) + 1
            open_ = ties[owner[ties] == 0]
            nearest = int(open_[0] if len(open_) else ties[-1])
            delta = free[nearest - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nearest
        while j:
            owner[j], j = owner[way[j]], way[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, columns + 1) if owner[j])


def _letters():
    """A, B, ... Z, AA, AB, ..."""
    for n in count(1):
        yield from map("".join, product(ascii_uppercase, repeat=n))


def mapping_of(shared: np.ndarray) -> dict[int, int]:
    """Hypothesis to reference labels (numbers in label order) of the largest shared time.

    Ties are decided as by an evaluation that names the reference's labels A, B, ... and the
    hypothesis' 0, 1, ..., and sorts these names.
    """
    refs = sorted(range(shared.shape[0]), key=[x for x, _ in zip(_letters(), range(shared.shape[0]))].__getitem__)
    hyps = sorted(range(shared.shape[1]), key=str)
    pairs = [(hyps[i], refs[j]) for i, j in assignment(shared[np.ix_(refs, hyps)].T.astype(float))]
    return {h: r for h, r in pairs if shared[r, h] > 0}


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals of one label; those that only touch stay apart."""
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    reach = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.r_[True, lo[1:] >= reach[:-1]])
    return lo[first], np.maximum.reduceat(hi, first)


@dataclass
class Cells:
    """Scored cells of a meeting: their lengths, and which labels are active in them."""

    d: np.ndarray
    refs: list[str]
    hyps: list[str]
    r: np.ndarray  # labels x cells
    h: np.ndarray
    overlap: np.ndarray  # cells with two or more reference labels
    overlap_time: int


def cells_of(side: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, collar: int = 0, duration: int | None = None, skip_overlap: bool = False) -> Cells:
    """From 0 to ``duration``, or else the extent of both sides; without ``collar`` centred on the
    reference's boundaries, and without overlapped reference time if asked."""
    names = {s: sorted(set(label[side == s].tolist())) for s in "RH"}
    tracks = {(s, x): merged(lo[mine], hi[mine]) for s in "RH" for x in names[s] for mine in [(side == s) & (label == x)]}
    edges = np.concatenate([np.concatenate(t) for (s, _), t in tracks.items() if s == "R"] or [np.empty(0, np.int64)])
    region = (0, duration) if duration is not None else (int(lo.min()), int(hi.max()))
    times = np.unique(np.concatenate([*[x for t in tracks.values() for x in t], edges - collar // 2, edges + collar // 2, region]))

    def active(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        change = np.zeros(len(times), np.int64)
        np.add.at(change, np.searchsorted(times, a), 1)
        np.add.at(change, np.searchsorted(times, b), -1)
        return np.cumsum(change)[:-1] > 0

    r, h = (np.array([active(*tracks[s, x]) for x in names[s]], bool).reshape(len(names[s]), len(times) - 1) for s in "RH")
    inside = (times[:-1] >= region[0]) & (times[1:] <= region[1])
    d, several = np.diff(times), r.sum(0) >= 2
    overlap_time = int(d[inside & several].sum())
    if collar // 2:
        inside &= ~active(edges - collar // 2, edges + collar // 2)
    if skip_overlap:
        inside &= ~several
    return Cells(d[inside], names["R"], names["H"], r[:, inside], h[:, inside], several[inside], overlap_time)


def shared_out(time: np.ndarray, among: np.ndarray) -> float:
    """The sum of each cell's time divided among so many labels, exact and rounded once at its end, so that
    halves of a microsecond are halves whatever the order of the cells."""
    sums = {n: int(time[among == n].sum()) for n in np.unique(among[time > 0]).tolist()}
    whole = lcm(*sums)
    return sum(s * (whole // n) for n, s in sums.items()) / whole


def scores_of(c: Cells) -> dict:
    """All figures of a meeting's cells."""
    d, r, h = c.d, c.r.astype(np.int64), c.h.astype(np.int64)
    shared = (r * d) @ h.T
    kept = [i for i in range(len(c.refs)) if c.r[i].any()]  # labels left in the scored time
    held = [j for j in range(len(c.hyps)) if c.h[j].any()]
    to = {held[b]: kept[a] for b, a in mapping_of(shared[np.ix_(kept, held)]).items()}
    back = {a: b for b, a in to.items()}
    correct = np.zeros_like(d) if not to else sum(r[a] & h[b] for b, a in to.items())
    nr, nh = r.sum(0), h.sum(0)
    miss, fa, conf = np.maximum(0, nr - nh), np.maximum(0, nh - nr), np.minimum(nr, nh) - correct
    whole = {k: int((d * x).sum()) for k, x in (("total", nr), ("miss", miss), ("fa", fa), ("conf", conf), ("correct", correct))}
    part = {f"overlap_{k}": int((d * x)[c.overlap].sum()) for k, x in (("total", nr), ("miss", miss), ("fa", fa), ("conf", conf), ("correct", correct))}
    speakers, left_r, left_h = {}, nr - correct, nh - correct
    for a, name in enumerate(c.refs):
        b = back.get(a)
        hit = r[a] & h[b] if b is not None else np.zeros_like(d)
        alone = r[a] - hit
        false = h[b] - hit if b is not None else np.zeros_like(d)
        size, met = int((d * r[a]).sum()), int(shared[a, b]) if b is not None else 0
        union = size + (int((d * h[b]).sum()) if b is not None else 0) - met
        speakers[name] = {
            "mapped_to": c.hyps[b] if b is not None else None,
            "total": size,
            "correct": int((d * hit).sum()),
            "miss": shared_out(d * miss * alone, left_r),
            "conf": shared_out(d * conf * alone, left_r),
            "fa": shared_out(d * fa * false, left_h),
            "jer": 1 - met / union if a in kept else None,
        }
    for b, label in enumerate(c.hyps):
        if b not in to:
            name, n = f"hyp:{label}", 2
            while name in speakers:  # a reference speaker of that name
                name, n = f"hyp:{label}#{n}", n + 1
            speakers[name] = {"mapped_to": None, "total": 0, "correct": 0, "miss": 0.0, "conf": 0.0, "fa": shared_out(d * fa * h[b], left_h), "jer": None}
    each = [x["jer"] for x in speakers.values() if x["jer"] is not None]
    return whole | part | {
        "overlap_time": c.overlap_time,
        "n_ref": len(each),
        "jer": sum(each) / len(each) if each else None,
        "mapping": [{"ref": c.refs[a], "hyp": c.hyps[b], "shared": int(shared[a, b])} for a, b in sorted(back.items())],
        "speakers": [{"speaker": k} | v for k, v in speakers.items()],
    }


def _arrow_schema(text: bool) -> pa.Schema:
    pair = pa.struct([("ref", pa.string()), ("hyp", pa.string()), ("shared", pa.int64())])
    speaker = pa.struct([("speaker", pa.string()), ("mapped_to", pa.string()), ("total", pa.int64()), ("correct", pa.int64()), *[(x, pa.float64()) for x in ("miss", "conf", "fa", "jer")]])
    kinds = {"meeting_id": pa.string() if text else pa.int64(), "jer": pa.float64(), "mapping": pa.list_(pair), "speakers": pa.list_(speaker)}
    return pa.schema([(x.split()[0], kinds.get(x.split()[0], pa.int64())) for x in SCORES.replace(SPEAKER, "s").replace("ref:string,hyp:string,shared:bigint", "p").split(", ")])


def meeting_scores(segments: DataFrame, collar: int = 0, duration: int | None = None, skip_overlap: bool = False) -> DataFrame:
    """One row per meeting: components of the error rate, the same inside overlapped reference
    time under the same mapping, the Jaccard error rate, the mapping, and a row per speaker.

    A column ``duration`` of the segments gives each meeting its own scored region. Segments without a side,
    a label or a length aren't scored."""
    if collar < 0:
        raise ValueError("a collar is a finite number, 0 or more")

    def score(table: pa.Table) -> pa.Table:
        side, label = (np.array(table.column(x).to_pylist(), object) for x in ("side", "label"))
        lo, hi = (table.column(x).to_numpy() for x in ("lo", "hi"))
        until = table.column("duration")[0].as_py() if own else duration
        found = scores_of(cells_of(side, label, lo, hi, collar, until, skip_overlap))
        return pa.Table.from_pylist([{"meeting_id": table.column("meeting_id")[0].as_py()} | found], schema=schema)

    own = "duration" in segments.columns
    kind = segments.schema["meeting_id"].dataType.simpleString()
    text = kind == "string"
    schema = _arrow_schema(text)
    return segments.select("meeting_id", "side", "label", "lo", "hi", *(["duration"] if own else [])).where("hi > lo and side in ('R', 'H') and label is not null").groupBy("meeting_id").applyInArrow(score, SCORES.replace("meeting_id long", "meeting_id string") if text else SCORES)


def rates(scores: DataFrame, prefix: str = "", silent: bool = False) -> DataFrame:
    """meeting_id, total, miss, fa, conf, correct, der of ``meeting_scores``; with the prefix
    ``overlap_`` those of overlapped time. Meetings without any speech in the scored time are left out, or
    with ``silent`` have zeros and a null rate."""
    parts = {x: F.col(f"{prefix}{x}").alias(x) for x in ("total", "miss", "fa", "conf", "correct")}
    rows = scores.select("meeting_id", *parts.values()).where(F.lit(silent) | (F.col("total") + F.col("fa") > 0))
    return rows.withColumn("der", F.try_divide(F.col("miss") + F.col("fa") + F.col("conf"), "total"))


def diarization_error(segments: DataFrame, collar: int = 0, duration: int | None = None, skip_overlap: bool = False) -> DataFrame:
    return rates(meeting_scores(segments, collar, duration, skip_overlap))


def overlap_error(segments: DataFrame, collar: int = 0, duration: int | None = None) -> DataFrame:
    return rates(meeting_scores(segments, collar, duration), "overlap_")


def jaccard_error(segments: DataFrame, collar: int = 0, duration: int | None = None, skip_overlap: bool = False) -> DataFrame:
    """meeting_id, n_ref, jer: mean over reference labels of 1 - intersection / union."""
    return meeting_scores(segments, collar, duration, skip_overlap).where("n_ref > 0").select("meeting_id", "n_ref", "jer")


def per_speaker(segments: DataFrame, collar: int = 0, duration: int | None = None, skip_overlap: bool = False) -> DataFrame:
    """meeting_id and a row per speaker: what is missed or confused is shared equally by the cell's
    unmatched reference labels, what is false by its unmatched hypothesis labels; that goes to
    the mapped speaker, or to ``hyp:`` and the label."""
    return meeting_scores(segments, collar, duration, skip_overlap).select("meeting_id", F.inline("speakers"))


def best_mapping(segments: DataFrame, collar: int = 0, duration: int | None = None, skip_overlap: bool = False) -> DataFrame:
    return meeting_scores(segments, collar, duration, skip_overlap).select("meeting_id", F.inline("mapping"))
