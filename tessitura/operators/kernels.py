"""Sequential kernels: pitch tracking, path decoding, octave repair, alignment. NumPy inside, one clip or chunk at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.music import EQUAL, FMAX, FMIN, HOP, JUST, WINDOW


def yin(x: np.ndarray, rate: int, window: int = WINDOW, hop: int = HOP, fmin: float = FMIN, fmax: float = FMAX, threshold: float = 0.15, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(f0, confidence, rms) of frames first to last - 1: the cumulative mean normalised difference, by Fourier transform, refined by a parabola.

    Clips shorter than a window and the longest lag have no frames."""
    most, least = min(int(rate // fmin), window - 1), max(2, int(rate // fmax))
    n = max(0, (len(x) - window - most) // hop)
    n = n if last is None else min(n, last)
    out: list[tuple[np.ndarray, ...]] = []
    size = 1 << int(np.ceil(np.log2(2 * window + most)))
    x = np.asarray(x, np.float64)
    for s in range(first, n, 256):
        e = min(s + 256, n)
        rows = np.lib.stride_tricks.sliding_window_view(x, window + most)[s * hop : (e - 1) * hop + 1 : hop]
        head = rows[:, :window]
        cross = np.fft.irfft(np.conj(np.fft.rfft(head, size)) * np.fft.rfft(rows, size), size)[:, : most + 1]
        square = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(rows**2, 1)], 1)
        energy = square[:, window : window + most + 1] - square[:, : most + 1]
        d = np.maximum(0, energy[:, :1] + energy - 2 * cross)
        d[:, 0] = 0
        run = np.cumsum(d, 1)
        lag = np.arange(most + 1)
        cm = np.where(run > 0, d * lag / np.where(run > 0, run, 1), 1.0)
        cm[:, 0] = 1
        body = cm[:, least:]
        below = body < threshold
        at = np.where(below.any(1), below.argmax(1), body.argmin(1)) + least
        # From the first lag below the threshold on down to where the curve turns up.
        rising = np.concatenate([cm[:, 1:] >= cm[:, :-1], np.ones((len(rows), 1), bool)], 1)
        after = lag[None, :] >= at[:, None]
        at = np.where(below.any(1), (rising & after).argmax(1), at)
        i = np.arange(len(rows))
        inner = (at > least) & (at < most)
        y0, y1, y2 = cm[i, np.maximum(at - 1, 0)], cm[i, at], cm[i, np.minimum(at + 1, most)]
        bend = 2 * (2 * y1 - y2 - y0)
        fine = np.where(inner & (bend != 0), at + (y2 - y0) / np.where(bend != 0, bend, 1), at)
        out.append((np.where(fine > 0, rate / fine, 0.0), np.clip(1 - y1, 0, 1), np.sqrt(energy[:, 0] / window)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0),) * 3


def yin_track(clips: DataFrame) -> DataFrame:
    """Frames (clip_id, i, f0, conf, rms) of clips (clip_id, sr, pcm). A clip without samples has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for clip, rate, pcm in zip(batch["clip_id"], batch["sr"], batch["pcm"]):
                f0, conf, rms = yin(np.array([] if pcm is None else pcm), int(rate))
                yield pd.DataFrame({"clip_id": clip, "i": np.arange(len(f0)), "f0": f0, "conf": conf, "rms": rms})

    return clips.select("clip_id", "sr", "pcm").mapInPandas(run, "clip_id long, i long, f0 double, conf double, rms double")


def repair(cents: np.ndarray, voiced: np.ndarray, half: int = 8, band: float = 260.0, passes: int = 2) -> np.ndarray:
    """Frames about an octave off the median of their voiced neighbours (four at least) are folded to it; from left to right, fixes seen by what follows."""
    c = cents.astype(float).copy()
    at = np.flatnonzero(voiced)
    first, last = np.searchsorted(at, at - half), np.searchsorted(at, at + half, "right")
    for _ in range(passes):
        v = c[at]
        for k in np.flatnonzero(last - first >= 5).tolist():
            near = sorted([*v[first[k] : k].tolist(), *v[k + 1 : last[k]].tolist()])
            n = len(near)
            off = v[k] - (near[n // 2] if n % 2 else (near[n // 2 - 1] + near[n // 2]) / 2)
            if abs(off - 1200) < band:
                v[k] -= 1200
            elif abs(off + 1200) < band:
                v[k] += 1200
        c[at] = v
    return c


def repair_octaves(df: DataFrame) -> DataFrame:
    """Adds ``repaired`` to (clip_id, i, cents, voiced)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        voiced = pdf["voiced"].to_numpy(bool)
        fixed = repair(pdf["cents"].fillna(0.0).to_numpy(), voiced)
        return pd.DataFrame({"clip_id": pdf["clip_id"], "i": pdf["i"], "repaired": np.where(voiced, fixed, np.nan)})

    return df.select("clip_id", "i", "cents", "voiced").groupBy("clip_id").applyInPandas(run, "clip_id long, i long, repaired double")


def in_order(df: DataFrame) -> DataFrame:
    """Adds ``__k``, a row's number in its clip. So the rows of a clip lie one after another in one partition, for ``whole_clips``."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("clip_id").orderBy("i")))


def whole_clips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows of ``in_order`` cut anew, so that none ends within a clip: what is held is a batch and a clip, and a batch's clips share its costs."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        starts = np.flatnonzero(batch["__k"].to_numpy() == 1)
        if len(starts):
            if held or starts[-1]:
                yield pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True)
            held = [batch.iloc[starts[-1] :]]
        elif len(batch):
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def spans(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """Where the clips of ``whole_clips`` begin and end."""
    at = [*np.flatnonzero(pdf["__k"].to_numpy() == 1).tolist(), len(pdf)]
    return list(zip(at, at[1:]))


def repaired(df: DataFrame) -> DataFrame:
    """(clip_id, i, cents, voiced, conf) with octaves repaired in the cents of voiced frames; the others stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_clips(batches):
            voiced, c = pdf["voiced"].to_numpy(bool), pdf["cents"].to_numpy(float)
            fixed = [np.where(voiced[a:b], repair(np.nan_to_num(c[a:b]), voiced[a:b]), c[a:b]) for a, b in spans(pdf)]
            yield pdf.drop(columns="__k").assign(cents=pd.array(np.concatenate(fixed), "Float64"))

    return in_order(df.select("clip_id", "i", "cents", "voiced", "conf")).mapInPandas(run, "clip_id long, i long, cents double, voiced boolean, conf double")


def viterbi(cents: np.ndarray, voiced: np.ndarray, conf: np.ndarray, states: np.ndarray, sigma: float = 55.0, switch: float = 5.0, silence: float = 6.0, up: np.ndarray | None = None, down: np.ndarray | None = None, slope: np.ndarray | None = None, occupancy: float = 2.2, direction: float | None = None) -> np.ndarray:
    # The weights of confidence (0.35, 0.65), the slope from which a glide counts (4 cents a frame) and the cost of silence (1.5 switches).
    """State of each frame, -1 for silence. states: cents, ascending. up, down: whether a state may be entered rising or falling (the tonic always may).

    Staying is free; a switch costs ``switch``, to or from silence half as much again; on ties staying wins, then the lowest state."""
    n, k = len(cents), len(states)
    if not n or not k:
        return np.full(n, -1)
    cost = np.full((k + 1, k + 1), float(switch))
    cost[k, :] = cost[:, k] = 1.5 * switch
    if up is not None:
        d = switch if direction is None else direction
        rising = states[None, :] > states[:, None]
        cost[:k, :k] += np.where(rising, ~up[None, :], ~down[None, :]) * d
    np.fill_diagonal(cost, 0)
    emit = np.empty((n, k + 1))
    z = (np.nan_to_num(cents)[:, None] - states) / sigma
    emit[:, :k] = np.where(voiced[:, None], -0.5 * z * z * (0.35 + 0.65 * conf[:, None]), -silence)
    if up is not None and slope is not None:
        emit[:, :k] -= occupancy * voiced[:, None] * ((slope[:, None] > 4) & ~up | (slope[:, None] < -4) & ~down)
    emit[:, k] = np.where(voiced, -silence, 0.0)
    back, best, own = np.zeros((n, k + 1), np.int32), emit[0].copy(), np.arange(k + 1)
    for i in range(1, n):
        v = best[:, None] - cost
        j = v.argmax(0)
        j = np.where(v[own, own] >= v[j, own], own, j)
        back[i] = j
        best = v[j, own] + emit[i]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return np.where(path == k, -1, path)


def viterbi_decode(df: DataFrame, positions: list[int], labels: list[str], **how) -> DataFrame:
    """(clip_id, i, label, oct): the cheapest path of each clip through the scale's places within 150 cents of its range; null for silence."""
    table = [(o * 1200 + EQUAL[p], s, o) for o in range(-3, 4) for p, s in zip(positions, labels)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        voiced, cents = pdf["voiced"].to_numpy(bool), pdf["cents"].to_numpy(float)
        low, high = (cents[voiced].min(), cents[voiced].max()) if voiced.any() else (-1200, 1200)
        states = [t for t in table if low - 150 <= t[0] <= high + 150]
        path = viterbi(cents, voiced, pdf["conf"].to_numpy(float), np.array([t[0] for t in states], float), **how)
        return pd.DataFrame({"clip_id": pdf["clip_id"].to_numpy(), "i": pdf["i"].to_numpy(), "label": [states[p][1] if p >= 0 else None for p in path], "oct": pd.array([states[p][2] if p >= 0 else None for p in path], "Int32")})

    return df.select("clip_id", "i", "cents", "voiced", "conf").groupBy("clip_id").applyInPandas(run, "clip_id long, i long, label string, oct int")


def viterbi_all(clips: list[dict], sigma: float = 55.0, switch: float = 5.0, silence: float = 6.0, occupancy: float = 2.2, direction: float | None = None) -> list[np.ndarray]:
    """``viterbi`` of many clips (cents, voiced, conf, states, up, down, slope; up and down None without grammar), a frame of all at a time.

    Shorter clips stand still at their end, and places that a clip lacks cost infinitely much; silence comes last, so ties fall as there."""
    n, k, many = max(len(c["cents"]) for c in clips), max(len(c["states"]) for c in clips), len(clips)
    cost, emit = np.full((many, k + 1, k + 1), np.inf), np.full((many, n, k + 1), -np.inf)  # cost: to, from
    for m, c in enumerate(clips):
        own, length, states, voiced, up, down = len(c["states"]), len(c["cents"]), c["states"], c["voiced"], c["up"], c["down"]
        move = np.full((own, own), float(switch))
        z = (np.nan_to_num(c["cents"])[:, None] - states) / sigma
        heard = np.where(voiced[:, None], -0.5 * z * z * (0.35 + 0.65 * c["conf"][:, None]), -silence)
        if up is not None:
            move += np.where(states[None, :] > states[:, None], ~up[None, :], ~down[None, :]) * (switch if direction is None else direction)
            heard -= occupancy * voiced[:, None] * ((c["slope"][:, None] > 4) & ~up | (c["slope"][:, None] < -4) & ~down)
        cost[m, :own, :own] = move.T
        cost[m, k, :own] = cost[m, :own, k] = 1.5 * switch
        emit[m, :length, :own] = heard
        emit[m, :length, k] = np.where(voiced, -silence, 0.0)
    own = np.arange(k + 1)
    cost[:, own, own] = 0
    going = np.arange(n)[None, :] < np.array([len(c["cents"]) for c in clips])[:, None]
    back, best = np.zeros((n, many, k + 1), np.int32), emit[:, 0].copy()
    for i in range(1, n):
        v = best[:, None, :] - cost
        j = v.argmax(2)
        at = np.take_along_axis(v, j[:, :, None], 2)[:, :, 0]
        stay = best >= at
        on = going[:, i, None]
        back[i] = np.where(stay | ~on, own, j)
        best = np.where(on, np.where(stay, best, at) + emit[:, i], best)
    path, each = np.empty((n, many), np.int64), np.arange(many)
    path[-1] = best.argmax(1)
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, each, path[i]]
    path[path == k] = -1
    return [path[: len(c["cents"]), m] for m, c in enumerate(clips)]


#: Clips that are decoded together, and the frames of theirs, ends filled up: what the kernel holds and what stays in a cache.
TOGETHER, FRAMES = 64, 1 << 16


def decode_clips(contour: DataFrame, clips: DataFrame, cfg) -> DataFrame:
    """The rows of contour (clip_id, i, cents, voiced, conf, slope) with ``state``: the cheapest path of each clip through its own scale.

    clips: (clip_id, positions, labels, up, down, applied), one row each. The places within 150 cents of the clip's range, all moved by the applied shift, are
    the states; with the grammar on, a place may be entered rising if its label is in ``up`` and falling if in ``down``, the tonic always. state:
    struct<cents,pos,label,oct>, null for silence. A clip's own scale goes to the kernel with its first frame alone."""
    table = JUST if cfg.temperament == "ji" else EQUAL
    columns = ["clip_id", "i", "cents", "voiced", "conf"]

    def clip(d: dict, own) -> tuple[list, dict]:
        voiced, cents, shift = d["voiced"], d["cents"], float(own["applied"])
        low, high = (cents[voiced].min(), cents[voiced].max()) if voiced.any() else (-1200.0, 1200.0)
        every = [(o * 1200 + table[p] + shift, int(p), s, o) for o in range(-3, 4) for p, s in zip(own["positions"], own["labels"])]
        states = sorted((t for t in every if low - 150 <= t[0] <= high + 150), key=lambda t: t[0])
        named = {c: set(own[c]) for c in ("up", "down")} if cfg.grammar else {}
        up, down = (np.array([t[2] == "S" or t[2] in named[c] for t in states], bool) if named else None for c in ("up", "down"))
        return states, d | {"states": np.array([t[0] for t in states], float), "up": up, "down": down}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_clips(batches):
            column = {"cents": pdf["cents"].to_numpy(float), "voiced": pdf["voiced"].to_numpy(bool), "conf": pdf["conf"].to_numpy(float), "slope": np.nan_to_num(pdf["slope"].to_numpy(float))}
            own, at = pdf["own"].to_numpy(), spans(pdf)
            out = {"s_cents": np.full(len(pdf), np.nan), "s_pos": np.zeros(len(pdf), np.int32), "s_label": np.full(len(pdf), None, object), "s_oct": np.zeros(len(pdf), np.int32)}
            todo = sorted(at, key=lambda s: s[0] - s[1])  # the longest first
            while todo:
                count = max(1, min(TOGETHER, FRAMES // (todo[0][1] - todo[0][0])))
                now, todo = todo[:count], todo[count:]
                read = [clip({c: x[a:b] for c, x in column.items()}, own[a]) for a, b in now]
                for (a, b), (states, _), path in zip(now, read, viterbi_all([d for _, d in read], cfg.sigma, cfg.switch, cfg.silence_penalty, cfg.occupancy, cfg.direction)):
                    for name, values, none in zip(out, zip(*states), (np.nan, 0, None, 0)):
                        out[name][a:b] = np.array([*values, none], out[name].dtype)[path]
            yield pdf[columns].assign(**out)

    d = contour.join(clips.select("clip_id", F.struct("positions", "labels", "up", "down", "applied").alias("own")), "clip_id")
    d = in_order(d).select(*columns, "slope", "__k", F.when(F.col("__k") == 1, F.col("own")).alias("own"))
    d = d.mapInPandas(run, "clip_id long, i long, cents double, voiced boolean, conf double, s_cents double, s_pos int, s_label string, s_oct int")
    state = F.struct(*[F.col(f"s_{c}").alias(c) for c in ("cents", "pos", "label", "oct")])
    return d.select(*columns, F.when(F.col("s_cents").isNotNull(), state).alias("state"))


def align(a: list, b: list, match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0) -> list[tuple[int, int]]:
    """Global alignment: pairs of places, -1 for a gap. Pairs win ties, then gaps in b."""
    n, m = len(a), len(b)
    s = np.zeros((n + 1, m + 1))
    s[:, 0], s[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    codes = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    own, steps = np.array([codes[x] for x in b], np.int64), gap * np.arange(m + 1)
    for i in range(1, n + 1):
        # A row at a time: pairs and gaps in b first; gaps in a then run along it.
        best = np.maximum(s[i - 1, :-1] + np.where(own == codes[a[i - 1]], match, mismatch), s[i - 1, 1:] + gap)
        s[i] = np.maximum.accumulate(np.append(s[i, 0], best) - steps) + steps
    out, i, j = [], n, m
    while i or j:
        if i and j and s[i, j] == s[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and s[i, j] == s[i - 1, j] + gap:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def align_sequences(pairs: DataFrame) -> DataFrame:
    """(id, n, matches, gaps) of pairs (id, a, b) of arrays; a null array is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, a, b in zip(batch["id"], batch["a"], batch["b"]):
                a, b = ([] if x is None else list(x) for x in (a, b))
                p = align(a, b)
                rows.append((i, len(p), sum(x >= 0 and y >= 0 and a[x] == b[y] for x, y in p), sum(x < 0 or y < 0 for x, y in p)))
            yield pd.DataFrame(rows, columns=["id", "n", "matches", "gaps"])

    return pairs.select("id", "a", "b").mapInPandas(run, "id long, n long, matches long, gaps long")


def octave_path(zipped: str, stray: float = 0.25) -> Column:
    """Of an array of struct<p,pin>: octaves -1, 0 or 1 with the least sum of intervals and of strays from the middle octave; pinned where marked; the lower cost, then the lower octave wins.

    Three states, so a fold over the array does it: the state is the last place, and for each octave the cheapest cost and its path. Null pins are open;
    a pin beyond the three octaves pins nothing else than itself, so such rows have no path. Sections are short; paths are copied at each step."""
    return F.expr(_octave_path(zipped, stray))


def _octave_path(zipped: str, stray: float = 0.25) -> str:
    state = "named_struct('p', 0, 'n', 0, 'c', array(0D, 0D, 0D), 'w', cast(array(array(), array(), array()) as array<array<int>>))"
    best = f"""transform(array(-1, 0, 1), o -> if(x.pin is not null and x.pin <> o, named_struct('cost', 1e300D, 'q', 0), if(a.n = 0, named_struct('cost', {stray} * abs(o), 'q', 0),
        least({", ".join(f"named_struct('cost', cast(a.c[{q + 1}] + {stray} * abs(o) + abs(x.p + 12 * o - a.p - {12 * q}) as double), 'q', {q})" for q in (-1, 0, 1))}))))"""
    step = f"""(a, x) -> transform(array({best}), b -> named_struct('p', x.p, 'n', a.n + 1, 'c', transform(b, s -> s.cost), 'w', transform(array(0, 1, 2), k -> array_append(if(a.n = 0, cast(array() as array<int>), a.w[b[k].q + 1]), k - 1))))[0]"""
    finish = "a -> if(a.n = 0, cast(array() as array<int>), a.w[array_min(transform(array(0, 1, 2), k -> named_struct('c', a.c[k], 'k', k))).k])"
    return f"aggregate({zipped}, {state}, {step}, {finish})"


def octave_resolver(rows: DataFrame) -> DataFrame:
    """(id, octaves) of rows (id, places array<int>, pins array<int>)."""
    zipped = F.transform(F.arrays_zip(F.col("places"), F.col("pins")), lambda z: F.struct(z["places"].cast("int").alias("p"), z["pins"].cast("int").alias("pin")))
    return rows.select("id", zipped.alias("__x")).select("id", octave_path("__x").alias("octaves"))


def verify_octaves(rows: DataFrame) -> DataFrame:
    """(id, marked, missed, blind): of the marks (pins) of each row how many are not found again when each alone is hidden, and how many places differ when all are."""
    zipped = F.transform(F.arrays_zip(F.col("places"), F.col("pins")), lambda z: F.struct(z["places"].cast("int").alias("p"), z["pins"].cast("int").alias("pin")))
    d = rows.select("id", zipped.alias("__x")).filter(F.exists("__x", lambda z: z["pin"].isNotNull()))
    hidden = lambda which: f"transform(__x, (z, j) -> named_struct('p', z.p, 'pin', if({which}, cast(null as int), z.pin)))"
    d = d.select("id", "__x", octave_path("__x").alias("__t"), octave_path(hidden("true")).alias("__b"))
    at = F.filter(F.transform("__x", lambda z, k: F.when(z["pin"].isNotNull(), k)), lambda k: k.isNotNull())
    d = d.select("id", "__x", "__t", "__b", at.alias("__at"))
    lost = F.expr(f"filter(__at, k -> get({_octave_path(hidden('j = k'))}, k) <> get(__t, k))")
    blind = F.filter(F.zip_with("__t", "__b", lambda x, y: x != y), lambda d: d)
    return d.select("id", F.size("__at").cast("long").alias("marked"), F.size(lost).cast("long").alias("missed"), F.size(blind).alias("blind"))


def resample(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Linear interpolation at the new rate, without a filter; floor(n / ratio) samples."""
    ratio = rate_in / rate_out
    m = int(len(x) // ratio)
    return np.interp(np.arange(m) * ratio, np.arange(len(x)), x) if m else np.zeros(0)


def mixdown_resample(clips: DataFrame, rate_out: int) -> DataFrame:
    """(clip_id, sr, pcm) of clips (clip_id, sr, channels: array<array<double>>): the mean of the channels at the new rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pcm = [resample(np.mean([np.asarray(c, float) for c in channels], 0), int(sr), rate_out) if channels is not None and len(channels) else np.zeros(0) for channels, sr in zip(batch["channels"], batch["sr"])]
            yield pd.DataFrame({"clip_id": batch["clip_id"], "sr": rate_out, "pcm": pcm})

    return clips.select("clip_id", "sr", "channels").mapInPandas(run, "clip_id long, sr int, pcm array<double>")


def clean_slips(df: DataFrame, half: int = 8, band: float = 260.0) -> DataFrame:
    """Adds ``clean`` to (clip_id, i, cents, voiced): after the fact, frames one or two octaves off the median of their voiced neighbours on both sides (four at
    least) moved to it; all judged on the input."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        voiced, c = pdf["voiced"].to_numpy(bool), pdf["cents"].to_numpy(float)
        held = np.where(voiced, c, np.nan)
        padded = np.concatenate([np.full(half, np.nan), held, np.full(half, np.nan)])
        near = np.delete(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), half, 1) if len(c) else np.zeros((0, 2 * half))
        count = np.isfinite(near).sum(1)
        middle = np.full(len(c), np.nan)
        on = voiced & (count >= 4)
        middle[on] = np.nanmedian(near[on], 1)
        off = np.nan_to_num(held - middle)
        steps = np.floor(np.abs(off) / 1200 + 0.5)
        slip = on & (steps >= 1) & (steps <= 2) & (np.abs(np.abs(off) - 1200 * steps) < band)
        return pd.DataFrame({"clip_id": pdf["clip_id"], "i": pdf["i"], "clean": np.where(slip, held - np.sign(off) * 1200 * steps, held)})

    return df.select("clip_id", "i", "cents", "voiced").groupBy("clip_id").applyInPandas(run, "clip_id long, i long, clean double")
