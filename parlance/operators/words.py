"""Word error rates of meetings: by label, concatenated, and under the best permutation of
speakers, with and without time constraints.

Segments (meeting_id, side R or H, label, lo, hi, tokens: normalised words) are grouped by
meeting in one shuffle; a meeting's transcripts are aligned a word at a time, for all words of
the other side at once. A group holds one meeting's words, and of the distance table two bits for
each pair of words, or a byte under time constraints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.scoring import assignment

#: More speakers than this on either side are not scored under permutations.
SPEAKER_LIMIT = 20
TCP_COLLAR = 5_000_000


class _Steps:
    """Where the distance table goes up or down by one along the reference, after each word of the
    hypothesis, as bits of whole numbers (Myers 1999; Hyyrö 2003)."""

    def __init__(self, ref: np.ndarray, hyp: np.ndarray):
        places: dict[int, int] = {}
        for i, w in enumerate(ref.tolist()):
            places[w] = places.get(w, 0) | 1 << i
        full, last = (1 << len(ref)) - 1, 1 << len(ref) - 1
        up, down, self.distance = full, 0, len(ref)
        self.up, self.down = [up], [down]
        for w in hyp.tolist():
            same = places.get(w, 0)
            zero = (((same & up) + up) ^ up) | same | down
            right, left = down | full & ~(zero | up), zero & up
            self.distance += bool(right & last) - bool(left & last)
            right, left = right << 1 | 1, left << 1
            up, down = full & (left | ~(zero | right)), full & right & zero
            self.up.append(up)
            self.down.append(down)

    def at(self, i: int, j: int) -> int:
        """The step from i - 1 to i words of the reference, at j words of the hypothesis."""
        return (self.up[j] >> i - 1 & 1) - (self.down[j] >> i - 1 & 1)


def _timed_costs(ref: np.ndarray, hyp: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """What aligning two words costs more than leaving out that of the hypothesis: -1, 0, or 1 where they may not be
    aligned, as much as leaving out one and putting in the other."""
    cost = (ref[:, None] != hyp[None, :]).astype(np.int8) - np.int8(1)
    cost[apart] = 1
    return cost


def _timed_rows(costs: np.ndarray, row: np.ndarray):
    """Rows of the distance table after each word of the reference, less the places in them; ``row``: that before, zeros.
    Its last axis is the hypothesis; what comes before it are tables side by side. Two rows are used in turn."""
    rows, one = (row, np.empty_like(row)), np.ones((), row.dtype)
    met, pairs = np.empty(row[..., 1:].shape, row.dtype), [(rows[i][..., :-1], rows[1 - i], rows[1 - i][..., 1:]) for i in (0, 1)]
    for i, cost in enumerate(costs):
        before, new, after = pairs[i % 2]
        np.add(rows[i % 2], one, out=new)
        np.add(before, cost, out=met)
        np.minimum(after, met, out=after)
        np.minimum.accumulate(new, axis=-1, out=new)
        yield new


def timed_distances(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 1 << 22) -> tuple[list[int], dict]:
    """``distance`` of many (ref, hyp, apart), whose tables are filled side by side, a few million cells at once; and, of
    pairs that fit in one go, the ``steps`` of each by its number."""
    order = sorted((k for k, (ref, hyp, _) in enumerate(pairs) if len(ref) and len(hyp)), key=lambda k: len(pairs[k][0]))
    found, kept, first = [len(ref) + len(hyp) for ref, hyp, _ in pairs], {}, True
    while order:
        rows, columns, taken = len(pairs[order[-1]][0]), 0, []
        while order and (not taken or rows * max(columns, len(pairs[order[-1]][1])) * (len(taken) + 1) <= most):
            columns = max(columns, len(pairs[order[-1]][1]))
            taken.append(order.pop())
        kind = np.int16 if rows + columns < 1 << 15 else np.int32
        costs = np.zeros((rows, len(taken), columns), kind)
        for at, k in enumerate(taken):
            ref, hyp, apart = pairs[k]
            costs[: len(ref), at, : len(hyp)] = _timed_costs(ref, hyp, apart)
        ends: dict[int, list[int]] = {}
        for at, k in enumerate(taken):
            ends.setdefault(len(pairs[k][0]), []).append(at)
        keep, first, before = first and not order, False, np.zeros((len(taken), columns + 1), kind)
        steps = np.empty((rows, len(taken), columns + 1), np.int8) if keep else None
        for i, row in enumerate(_timed_rows(costs, before), 1):
            if keep:
                np.subtract(row, before, out=steps[i - 1], casting="unsafe")
                before = row
            for at in ends.get(i, ()):
                width = len(pairs[taken[at]][1])
                found[taken[at]] = int(row[at, width]) + width
        if keep:
            kept = {k: steps[:, at] for at, k in enumerate(taken)}
    return found, kept


class _TimedSteps:
    """The same where some pairs may not be aligned, a row of the table at a time."""

    def __init__(self, ref: np.ndarray, hyp: np.ndarray, apart: np.ndarray, steps: np.ndarray | None = None):
        self.steps = steps
        if steps is not None:
            return
        self.steps = np.empty((len(ref), len(hyp) + 1), np.int8)
        row = np.zeros(len(hyp) + 1, np.int32)
        for i, new in enumerate(_timed_rows(_timed_costs(ref, hyp, apart), row)):
            np.subtract(new, row, out=self.steps[i], casting="unsafe")
            row = new

    def at(self, i: int, j: int) -> int:
        return int(self.steps[i - 1, j])


def edits(ref: np.ndarray, hyp: np.ndarray, apart: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions, insertions of an optimal alignment of word numbers.

    Of several the one is taken that, from the end, prefers deletions, then insertions, after what
    both ends share. ``apart``: pairs that may not be aligned; ``known``: their steps,
    if they are there already.
    """
    same = 0
    if apart is None:
        short = min(len(ref), len(hyp))
        head = int(np.argmin(np.r_[ref[:short] == hyp[:short], False]))
        ref, hyp, short = ref[head:], hyp[head:], short - head
        tail = int(np.argmin(np.r_[ref[::-1][:short] == hyp[::-1][:short], False]))
        ref, hyp, same = ref[: len(ref) - tail], hyp[: len(hyp) - tail], head + tail
    if not len(ref) or not len(hyp):
        return same, 0, len(ref), len(hyp)
    steps = _Steps(ref, hyp) if apart is None else _TimedSteps(ref, hyp, apart, known)
    i, j, hits, subs, dels, ins = len(ref), len(hyp), same, 0, 0, 0
    while i and j:
        if steps.at(i, j) == 1:
            i, dels = i - 1, dels + 1
        elif j > 1 and steps.at(i, j - 1) == -1 or apart is not None and apart[i - 1, j - 1]:
            j, ins = j - 1, ins + 1
        else:
            i, j = i - 1, j - 1
            hits, subs = hits + int(ref[i] == hyp[j]), subs + int(ref[i] != hyp[j])
    return hits, subs, dels + i, ins + j


def distance(ref: np.ndarray, hyp: np.ndarray, apart: np.ndarray | None = None) -> int:
    if not len(ref) or not len(hyp):
        return len(ref) + len(hyp)
    if apart is None:
        return _Steps(ref, hyp).distance
    return timed_distances([(ref, hyp, apart)])[0][0]


def word_times(lo: int, hi: int, words: list[str], points: bool) -> tuple[np.ndarray, np.ndarray]:
    """A segment's time shared by its words by their lengths; with ``points`` only the middles."""
    ends = np.cumsum([0, *map(len, words)]) / max(1, sum(map(len, words)))
    starts, stops = lo + (hi - lo) * ends[:-1], lo + (hi - lo) * ends[1:]
    middle = (starts + stops) / 2
    return (middle, middle) if points else (starts, stops)


def permutation_errors(refs: dict, hyps: dict, apart_of=None) -> dict | None:
    """Errors under the assignment of speakers with the fewest; None beyond the limit of speakers."""
    if max(len(refs), len(hyps)) > SPEAKER_LIMIT:
        return None
    r, h = sorted(refs), sorted(hyps)
    size = len(r) + len(h)
    cost = np.zeros((size, size))
    apart = {(a, b): apart_of(a, b) if apart_of else None for a in r for b in h}
    if apart_of:
        errors, steps = timed_distances([(refs[a], hyps[b], x) for (a, b), x in apart.items()])
    else:
        errors, steps = [distance(refs[a], hyps[b]) for a, b in apart], {}
    cost[: len(r), : len(h)] = np.array(errors).reshape(len(r), len(h))
    for i, a in enumerate(r):
        cost[i, len(h) :] = len(refs[a])
    for j, b in enumerate(h):
        cost[len(r) :, j] = len(hyps[b])
    total, mapping = np.zeros(4, np.int64), []
    for i, j in assignment(-cost) if size else []:
        if i < len(r) and j < len(h):
            total += edits(refs[r[i]], hyps[h[j]], apart[r[i], h[j]], steps.get(i * len(h) + j))
            mapping.append({"ref": r[i], "hyp": h[j]})
        elif i < len(r):
            total += (0, 0, len(refs[r[i]]), 0)
            mapping.append({"ref": r[i], "hyp": None})
        elif j < len(h):
            total += (0, 0, 0, len(hyps[h[j]]))
            mapping.append({"ref": None, "hyp": h[j]})
    return _result(total, sum(map(len, refs.values()))) | {
        "missed_speakers": max(0, len(r) - len(h)),
        "false_speakers": max(0, len(h) - len(r)),
        "scored_speakers": len(r),
        "mapping": mapping,
    }


def _result(counts, length: int) -> dict:
    hits, subs, dels, ins = map(int, counts)
    errors = subs + dels + ins
    return {"rate": errors / length if length else None, "errors": errors, "length": length, "hits": hits, "substitutions": subs, "deletions": dels, "insertions": ins}


_COUNTS = [("rate", pa.float64()), *[(x, pa.int64()) for x in ("errors", "length", "hits", "substitutions", "deletions", "insertions")]]
_PLAIN = pa.struct(_COUNTS)
_SPEAKERS = pa.struct([*_COUNTS, *[(x, pa.int64()) for x in ("missed_speakers", "false_speakers", "scored_speakers")], ("mapping", pa.list_(pa.struct([("ref", pa.string()), ("hyp", pa.string())])))])
_FIELDS = [("literal", _PLAIN), ("concat", _PLAIN), ("cp", _SPEAKERS), ("tcp", _SPEAKERS), ("refused", pa.string())]
_C = "rate:double,errors:bigint,length:bigint,hits:bigint,substitutions:bigint,deletions:bigint,insertions:bigint"
_S = f"struct<{_C},missed_speakers:bigint,false_speakers:bigint,scored_speakers:bigint,mapping:array<struct<ref:string,hyp:string>>>"
SCORES = f"meeting_id long, literal struct<{_C}>, concat struct<{_C}>, cp {_S}, tcp {_S}, refused string"


KINDS = ("literal", "concat", "cp", "tcp")


def scores_of(rows: list[dict], collar: int = TCP_COLLAR, kinds: tuple[str, ...] = KINDS) -> dict:
    """The rates of one meeting's segments (side, label, lo, hi, tokens)."""
    rows = sorted((r for r in rows if r["tokens"]), key=lambda r: (r["lo"], r["hi"], r["label"]))
    number: dict[str, int] = {}
    code = lambda words: np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    words, times = {"R": {}, "H": {}}, {}
    for r in rows:
        words[r["side"]].setdefault(r["label"], []).extend(r["tokens"])
        times.setdefault((r["side"], r["label"]), []).append(word_times(r["lo"], r["hi"], r["tokens"], r["side"] == "H"))
    refs, hyps = ({k: code(w) for k, w in words[s].items()} for s in "RH")
    none = np.empty(0, np.int64)
    line = {s: code([w for r in rows if r["side"] == s for w in r["tokens"]]) for s in "RH"}
    spans = {k: [np.concatenate(x) for x in zip(*t)] for k, t in times.items()}

    def apart(a: str, b: str) -> np.ndarray:
        (start, stop), (lo, hi) = spans["R", a], spans["H", b]
        # a word of no length is met where it stands
        return ~((start[:, None] <= hi + collar) & (lo - collar <= stop[:, None]))

    length = len(line["R"])
    refused = None
    if max(len(refs), len(hyps)) > SPEAKER_LIMIT:
        refused = f"more than {SPEAKER_LIMIT} speakers (reference {len(refs)}, hypothesis {len(hyps)})"
    ways = {
        "literal": lambda: _result(sum((np.array(edits(refs.get(x, none), hyps.get(x, none))) for x in sorted({*refs, *hyps})), np.zeros(4, np.int64)), length),
        "concat": lambda: _result(edits(line["R"], line["H"]), length),
        "cp": lambda: permutation_errors(refs, hyps),
        "tcp": lambda: permutation_errors(refs, hyps, apart),
    }
    return {k: way() if k in kinds else None for k, way in ways.items()} | {"refused": refused}


def word_errors(
    segments: DataFrame, collar: int = TCP_COLLAR, kinds: tuple[str, ...] = KINDS, order: tuple[str, ...] = (), variant: str | None = None, variants: tuple[str, ...] = (), summed: str | None = None
) -> DataFrame:
    """One row per meeting: literal, concat, cp and tcp, each with its rate and counts; cp and tcp are
    null, with the reason, for meetings of too many speakers. Segments without words don't count.
    Of the ``kinds`` that aren't asked for there are nulls.

    Segments of one time and label come in the ``order`` of these columns. With ``variant``, a column of
    text, there is a row for each of ``variants`` (scored once where no segment has one): of its segments
    and those of none; ``summed`` is a column whose sum over them is kept."""
    if collar < 0:
        raise ValueError("a collar is a finite number, 0 or more")
    extra = [c for c in (variant, summed) if c]

    def score(table: pa.Table) -> pa.Table:
        rows = (table.sort_by([(c, "ascending") for c in order]) if order else table).select(columns).to_pylist()
        meeting = {"meeting_id": table.column("meeting_id")[0].as_py()}
        if not variant:
            return pa.Table.from_pylist([meeting | one(rows)], schema=schema)
        if all(r[variant] is None for r in rows):
            found = one(rows)
            return pa.Table.from_pylist([meeting | {variant: v} | found for v in variants], schema=schema)
        of = {v: one([r for r in rows if r[variant] in (None, v)]) for v in variants}
        return pa.Table.from_pylist([meeting | {variant: v} | found for v, found in of.items()], schema=schema)

    def one(rows: list[dict]) -> dict:
        return ({summed: sum(r[summed] or 0 for r in rows)} if summed else {}) | scores_of(rows, collar, kinds)

    columns = ["side", "label", "lo", "hi", "tokens", *extra]
    text = segments.schema["meeting_id"].dataType.simpleString() == "string"
    more = [*([(variant, pa.string())] if variant else []), *([(summed, pa.int64())] if summed else [])]
    schema = pa.schema([("meeting_id", pa.string() if text else pa.int64()), *more, *_FIELDS])
    # aligning takes long for few bytes: a fixed number of partitions isn't put together by their size
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.select("meeting_id", *columns, *order).repartition(parts, "meeting_id").groupBy("meeting_id")
    names = (f"{variant} string, " if variant else "") + (f"{summed} long, " if summed else "")
    return rows.applyInArrow(score, SCORES.replace("meeting_id long, ", f"meeting_id {'string' if text else 'long'}, {names}"))


def pooled(scores: DataFrame, kind: str, by: tuple[str, ...] = (), *more) -> DataFrame:
    """Micro and macro rates over meetings, of each ``by``; refused ones are counted, not pooled."""
    x = F.col(kind)
    return scores.groupBy(*by).agg(
        F.try_divide(F.sum(x["errors"]), F.sum(x["length"])).alias("micro"),
        F.avg(x["rate"]).alias("macro"),
        F.count(x["rate"]).alias("meetings"),
        F.count_if(x.isNull()).alias("not_scored"),
        *more,
    )
