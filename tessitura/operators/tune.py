"""Coordinate descent over decoding thresholds: all candidates of a key are scored in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.frames import melody_scores


#: What may be tuned for, as a mean over clips.
OBJECTIVES = {"overall": "overall", "pitch": "raw_pitch", "voicing": "(voicing_recall + 1 - false_alarm) / 2", "combined": "(raw_pitch + overall) / 2"}


def _scores(f: DataFrame, configs: list[dict], tune: bool, objective: str) -> list[float]:
    """Mean objective of each configuration over the clips' even (or odd) frames."""
    dim = f.sparkSession.createDataFrame([(n, c["min_conf"], c["silence"]) for n, c in enumerate(configs)], "n int, min_conf double, silence double")
    loud = f.withColumn("__top", F.max("rms").over(Window.partitionBy("clip_id"))).filter(F.col("i") % 2 == (0 if tune else 1))
    est = F.when((F.col("conf") >= F.col("min_conf")) & (F.col("rms") > F.col("__top") * F.col("silence")), F.col("f0")).otherwise(0.0)
    pairs = loud.crossJoin(F.broadcast(dim)).select("clip_id", "n", est.alias("est"), "gt")
    rows = melody_scores(pairs, ["clip_id", "n"]).groupBy("n").agg(F.avg(F.expr(OBJECTIVES[objective])).alias("s")).collect()
    return [x for _, x in sorted((r["n"], r["s"]) for r in rows)]


def coordinate_descent(f: DataFrame, grid: dict[str, list[float]], start: dict[str, float], rounds: int = 2, objective: str = "overall") -> DataFrame:
    """(step, key, value, score, held_out, overfit): the start and each accepted change; one must gain more than 1e-6. overfit: whether the held-out half has gained
    less than half of what the tuned half has, so far. The configurations are a few, so they cross the frames by broadcast."""
    f = f.persist()
    try:
        best = dict(start)
        (score,), (held,) = _scores(f, [best], True, objective), _scores(f, [best], False, objective)
        log = [(0, "start", 0.0, score, held, False)]
        for _ in range(rounds):
            for key, values in grid.items():
                tried = [best | {key: v} for v in values]
                found = _scores(f, tried, True, objective)
                top = max(range(len(found)), key=lambda k: (found[k], -k)) if found else 0
                if found and found[top] > score + 1e-6:
                    best, score = tried[top], found[top]
                    out = _scores(f, [best], False, objective)[0]
                    log.append((len(log), key, float(best[key]), score, out, out - held < (score - log[0][3]) / 2))
    finally:
        f.unpersist()
    return f.sparkSession.createDataFrame([(s, k, v, round(a, 6), round(b, 6), o) for s, k, v, a, b, o in log], "step int, key string, value double, score double, held_out double, overfit boolean")
