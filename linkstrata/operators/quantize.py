"""Quantisers, storage and error statistics of vectors.

Arithmetic is in double and rounding half to even. Null vectors give null codes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata.operators.vectors import doubles, let

FLOOR = 1e-12


def bits_of(mode: str) -> int:
    """Bits of int2..int8, fp16, fp32."""
    if mode in ("fp32", "fp16"):
        return int(mode[2:])
    if mode.startswith("int") and mode[3:].isdigit() and 2 <= int(mode[3:]) <= 8:
        return int(mode[3:])
    raise ValueError(f"no mode named {mode}")


def parse_modes(spec: str, tensors: list[str]) -> tuple[str, dict[str, str]]:
    """'label:tensor=mode,...' as label and the mode of each tensor, fp32 where none is given."""
    label, _, rest = spec.partition(":")
    modes = dict.fromkeys(tensors, "fp32")
    for part in filter(None, rest.split(",")):
        name, _, mode = part.partition("=")
        if name not in modes:
            raise ValueError(f"no tensor named {name}")
        bits_of(mode)
        modes[name] = mode
    return label, modes


def scale(v: Column, bits: int) -> Column:
    """max(|v|) / (2^(bits-1) - 1), not below 1e-12."""
    top = F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))
    return F.greatest(top / F.lit(float(2 ** (bits - 1) - 1)), F.lit(FLOOR))


def codes(v: Column, s: Column, bits: int) -> Column:
    """Symmetric codes of a vector under its scale."""
    most = float(2 ** (bits - 1) - 1)
    return let(s, lambda t: F.transform(doubles(v), lambda x: F.greatest(F.least(F.rint(x / t), F.lit(most)), F.lit(-most)).cast("tinyint")))


def decode(q: Column, s: Column) -> Column:
    return let(s, lambda t: F.transform(q, lambda x: x * t))


def half(v: Column) -> Column:
    """float16 and back: 11 significant bits, steps of 2^-24 below 2^-14; 65504 is the most."""

    def one(x: Column) -> Column:
        e = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 10)
        small = F.abs(x) < 2.0**-14
        return F.when(small, F.rint(x * 2.0**24) / 2.0**24).otherwise(F.greatest(F.least(F.rint(x / e) * e, F.lit(65504.0)), F.lit(-65504.0)))

    return F.transform(doubles(v), one)


def quantized(v: Column, s: Column, mode: str) -> Column:
    """The vector after a round trip through the mode; ``s``: its scale column (ignored by fp modes)."""
    if mode == "fp32":
        return doubles(v)
    return half(v) if mode == "fp16" else decode(codes(v, s, bits_of(mode)), s)


def packed(v: Column, mode: str) -> Column:
    """A vector as stored: codes and a scale in float16 precision, by which they are made; fp modes keep numbers as codes without a scale.

    struct<q: array<tinyint>, scale: double, plain: array<double>>; what a mode has no use for is null, as is a null vector.
    """
    no_codes, no_plain = F.lit(None).cast("array<tinyint>"), F.lit(None).cast("array<double>")
    if mode in ("fp32", "fp16"):
        return F.when(v.isNotNull(), F.struct(no_codes.alias("q"), F.lit(None).cast("double").alias("scale"), quantized(v, F.lit(0.0), mode).alias("plain")))
    s = F.get(half(F.array(scale(v, bits_of(mode)))), F.lit(0))
    # A scale that float16 can't hold is 0 there, and so are the codes.
    q = let(s, lambda t: F.transform(doubles(v), lambda x: F.when(t > 0, F.greatest(F.least(F.rint(x / t), F.lit(float(2 ** (bits_of(mode) - 1) - 1))), F.lit(-float(2 ** (bits_of(mode) - 1) - 1)))).otherwise(0.0).cast("tinyint")))
    return F.when(v.isNotNull(), F.struct(q.alias("q"), s.alias("scale"), no_plain.alias("plain")))


def unpacked(p: Column) -> Column:
    """The vector of a packed one."""
    return F.coalesce(p["plain"], decode(p["q"], p["scale"]))


def pack_tensors(rows: DataFrame, modes: dict[str, str]) -> DataFrame:
    """``rows`` with each tensor of ``modes`` packed in its own mode, in one pass."""
    return rows.withColumns({t: packed(F.col(t), m) for t, m in modes.items()})


def pack_report(rows: DataFrame, modes: dict[str, str]) -> DataFrame:
    """(tensor, mode, vectors, logical_bytes, physical_bytes, mae, max_error) of each tensor under its mode, from one pass over the table."""
    each = F.array(*(F.struct(F.lit(t).alias("tensor"), F.lit(m).alias("mode"), F.size(t).alias("n"), error_sums(F.col(t), unpacked(packed(F.col(t), m))).alias("e"), F.col(t).isNotNull().alias("ok")) for t, m in modes.items()))
    x = rows.select(F.explode(each).alias("x")).select("x.*").filter("ok")
    by = x.groupBy("tensor", "mode").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("vectors"), (F.sum("e.ad") / F.sum("n")).alias("mae"), F.max("e.md").alias("max_error"))
    logical, physical = F.lit(None).cast("long"), F.lit(None).cast("long")
    for m in sorted(set(modes.values())):
        logical = F.when(F.col("mode") == m, logical_bytes(F.col("n"), F.col("vectors"), m)).otherwise(logical)
        physical = F.when(F.col("mode") == m, physical_bytes(F.col("n"), F.col("vectors"), m)).otherwise(physical)
    return by.select("tensor", "mode", "vectors", logical.alias("logical_bytes"), physical.alias("physical_bytes"), "mae", "max_error")


def quantize_layers(weights: DataFrame, mode: str, chosen: Column) -> DataFrame:
    """``weights`` (layer, row, v) with the chosen layers' rows after a round trip, a scale for each output channel; the others as they are."""
    bits = bits_of(mode)
    q = doubles(F.col("v")) if bits == 32 else quantized(F.col("v"), scale(F.col("v"), bits if bits <= 8 else 8), mode)
    return weights.withColumn("chosen", F.coalesce(chosen, F.lit(False))).withColumn("v", F.when(F.col("chosen"), q).otherwise(doubles(F.col("v"))))


def layer_counts(quantised: DataFrame) -> DataFrame:
    """(layers, chosen_layers, parameters, chosen_parameters) of ``quantize_layers``."""
    n = quantised.groupBy("layer").agg(F.max("chosen").alias("chosen"), F.sum(F.size("v")).alias("n"))
    return n.agg(F.count("*").alias("layers"), F.count_if("chosen").alias("chosen_layers"), F.sum("n").alias("parameters"), F.coalesce(F.sum(F.when(F.col("chosen"), F.col("n"))), F.lit(0)).alias("chosen_parameters"))


def with_outliers(values: DataFrame, value: str, by: list[str], bits: int, how: str, width: float = 3.0) -> DataFrame:
    """``values`` with ``q``, the value after a round trip under its group's scale, and ``far``, whether it is an outlier.

    ``how``: 'clip' moves outliers to mean +- width sample deviations first, 'absorb' lets the scale take them in, 'fp16' keeps
    them in float16 and quantises the rest as if they were 0. The scale is the largest magnitude over 2^(bits-1) - 1.
    """
    if how not in ("clip", "absorb", "fp16"):
        raise ValueError(f"no handling named {how}")
    x, most = F.col(value), float(2 ** (bits - 1) - 1)
    stats = values.groupBy(*by).agg(F.avg(x).alias("_m"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("_s"))
    rows = values.join(F.broadcast(stats), by) if by else values.join(F.broadcast(stats))
    far = F.abs(x - F.col("_m")) > width * F.col("_s")
    lo, hi = F.col("_m") - width * F.col("_s"), F.col("_m") + width * F.col("_s")
    kept = {"clip": F.least(F.greatest(x, lo), hi), "absorb": x, "fp16": F.when(far, 0.0).otherwise(x)}[how]
    rows = rows.withColumn("far", far).withColumn("_y", kept)
    top = rows.groupBy(*by).agg(F.greatest(F.max(F.abs("_y")) / most, F.lit(FLOOR)).alias("_scale"))
    rows = rows.join(F.broadcast(top), by) if by else rows.join(F.broadcast(top))
    q = F.greatest(F.least(F.rint(F.col("_y") / F.col("_scale")), F.lit(most)), F.lit(-most)) * F.col("_scale")
    if how == "fp16":
        q = F.when(F.col("far"), F.get(half(F.array(x)), F.lit(0))).otherwise(q)
    return rows.withColumn("q", q).drop("_m", "_s", "_y", "_scale")


def straight_through(values: DataFrame, value: str, bits: int, symmetric: bool = True) -> DataFrame:
    """``values`` with ``q``: the forward value of quantisation-aware training, one scale for the table.

    Symmetric codes are clamped to both signs; affine ones to [0, 2^bits - 1] with a zero point that is no whole number. A scale of
    zero leaves values as they are. The gradient passes as if nothing was done, so only the forward value is here.
    """
    m = values.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    most = float(2 ** (bits - 1) - 1) if symmetric else float(2**bits - 1)
    s = F.greatest(F.abs(lo), F.abs(hi)) / most if symmetric else (hi - lo) / most
    q = F.greatest(F.least(F.rint(x / s), F.lit(most)), F.lit(-most)) * s if symmetric else (F.greatest(F.least(F.rint(x / s - lo / s), F.lit(most)), F.lit(0.0)) + lo / s) * s
    return values.join(F.broadcast(m)).withColumn("q", F.when(s > 0, q).otherwise(x)).drop("_lo", "_hi")


def sensitivity(rows: DataFrame, layer: str, v: str, bits: tuple[int, ...] = (2, 3, 4, 6, 8)) -> DataFrame:
    """(layer, bits, mse, snr_db): what each number of bits costs each layer, with one scale a layer. ``rows`` are its weights or its activations.

    All numbers of bits are taken in one pass over the rows, after one for the scales.
    """
    top = rows.groupBy(layer).agg(F.max(F.array_max(F.transform(doubles(F.col(v)), lambda x: F.abs(x)))).alias("_top"))
    each = F.array(*(F.struct(F.lit(b).alias("bits"), error_sums(F.col(v), fake_quantize(F.col(v), F.col("_top"), b)).alias("e")) for b in bits))
    x = rows.filter(F.col(v).isNotNull()).join(F.broadcast(top), layer).select(layer, F.explode(each).alias("x")).select(layer, "x.bits", "x.e")
    return error_stats(x, [layer, "bits"]).select(layer, "bits", "mse", "snr_db")


def norm_errors(rows: DataFrame, by: list[str], v: str = "v", q: str = "q") -> DataFrame:
    """(by, norm_error, max_error, mean_error): mean difference of norms, largest and mean difference of components."""
    size = lambda c: F.sqrt(F.aggregate(doubles(F.col(c)), F.lit(0.0), lambda s, x: s + x * x))
    gap = F.zip_with(doubles(F.col(v)), doubles(F.col(q)), lambda x, y: F.abs(x - y))
    x = rows.select(*by, F.abs(size(q) - size(v)).alias("d"), F.array_max(gap).alias("m"), F.aggregate(gap, F.lit(0.0), lambda s, x: s + x).alias("t"), F.size(v).alias("n"))
    return x.groupBy(*by).agg(F.avg("d").alias("norm_error"), F.max("m").alias("max_error"), (F.sum("t") / F.sum("n")).alias("mean_error"))


def shard_sizes(rows: DataFrame, shard: str, tensors: dict[str, str]) -> DataFrame:
    """(tensor, mode, bytes, shards, least, mean, most): logical bytes of each tensor over all shards, and of a shard."""
    each = F.array(*(F.struct(F.lit(t).alias("tensor"), F.lit(m).alias("mode"), F.coalesce(F.when(F.col(t).isNotNull(), F.size(t)), F.lit(0)).alias("n"), F.col(t).isNotNull().cast("int").alias("one")) for t, m in tensors.items()))
    by = rows.select(shard, F.explode(each).alias("x")).groupBy(shard, "x.tensor", "x.mode").agg(F.sum("x.n").alias("n"), F.sum("x.one").alias("vectors"))
    size = F.lit(None).cast("long")
    for m in sorted(set(tensors.values())):
        size = F.when(F.col("mode") == m, logical_bytes(F.col("n"), F.col("vectors"), m)).otherwise(size)
    return by.withColumn("b", size).groupBy("tensor", "mode").agg(F.sum("b").alias("bytes"), F.count("*").alias("shards"), F.min("b").alias("least"), F.avg("b").alias("mean"), F.max("b").alias("most"))


def seen_as(mode: str, normalise: bool = True):
    """A function of a matrix of row vectors: ``quantized`` of each row under its own scale, normalised after; for passes that hold batches as matrices."""
    bits = bits_of(mode)

    def view(x: np.ndarray) -> np.ndarray:
        if mode == "fp16":
            x = x.astype(np.float16).astype(np.float64)
        elif bits <= 8:
            most = 2 ** (bits - 1) - 1
            s = np.maximum(np.abs(x).max(1, keepdims=True) / most, FLOOR)
            x = np.clip(np.rint(x / s), -most, most) * s
        return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], FLOOR) if normalise else x

    return view


def affine(v: Column, lo: Column, hi: Column, bits: int) -> Column:
    """Round trip with a scale and zero point of the whole table; a range of zero leaves the vector as it is."""
    most = float(2**bits - 1)
    s = (hi - lo) / most
    z = -lo / s
    return F.when(hi > lo, F.transform(doubles(v), lambda x: (F.greatest(F.least(F.rint(x / s + z), F.lit(most)), F.lit(0.0)) - z) * s)).otherwise(doubles(v))


def fake_quantize(v: Column, top: Column, bits: int, compat: bool = False) -> Column:
    """Symmetric round trip with one scale for the table; ``compat`` clamps codes to [0, 2^bits - 1], losing all negatives."""
    most = float(2 ** (bits - 1) - 1)
    s = F.greatest(top / most, F.lit(FLOOR))
    lo, hi = (0.0, float(2**bits - 1)) if compat else (-most, most)
    return F.transform(doubles(v), lambda x: F.greatest(F.least(F.rint(x / s), F.lit(hi)), F.lit(lo)) * s)


def logical_bytes(n: Column, rows: Column, mode: str) -> Column:
    """Bytes of n numbers in so many vectors: 4n, 2n, or packed codes and a 4-byte scale a vector."""
    if mode in ("fp32", "fp16"):
        return (n * (bits_of(mode) // 8)).cast("long")
    return (F.ceil(n * bits_of(mode) / 8.0) + 4 * rows).cast("long")


def physical_bytes(n: Column, rows: Column, mode: str) -> Column:
    """Bytes as stored: a byte a code, a 2-byte scale."""
    return logical_bytes(n, rows, mode) if mode in ("fp32", "fp16") else (n + 2 * rows).cast("long")


def error_sums(v: Column, q: Column, top_code: Column | None = None) -> Column:
    """Sums for one vector, to be merged by ``error_stats``: n, |d|, max |d|, d^2, x^2, y^2, xy, sign flips, zeros."""
    pairs = F.zip_with(doubles(v), doubles(q), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p["x"], p["y"]))
    return F.struct(
        F.size(v).alias("n"), total(lambda x, y: F.abs(x - y)).alias("ad"), F.array_max(F.transform(pairs, lambda p: F.abs(p["x"] - p["y"]))).alias("md"),
        total(lambda x, y: (x - y) * (x - y)).alias("dd"), total(lambda x, y: x * x).alias("xx"), total(lambda x, y: y * y).alias("yy"),
        total(lambda x, y: x * y).alias("xy"), total(lambda x, y: F.when(x * y < 0, 1.0).otherwise(0.0)).alias("flip"),
        total(lambda x, y: F.when((y == 0) & (x != 0), 1.0).otherwise(0.0)).alias("zero"),
    )


def error_stats(rows: DataFrame, by: list[str], e: str = "e") -> DataFrame:
    """MAE, largest error, relative L2, cosine (mean, population deviation), sign-flip and zero rates, MSE and SNR in dB of each group."""
    c = lambda x: F.col(f"{e}.{x}")
    cos = c("xy") / F.greatest(F.sqrt(c("xx") * c("yy")), F.lit(FLOOR))
    n = F.sum(c("n"))
    return rows.groupBy(*by).agg(
        (F.sum(c("ad")) / n).alias("mae"), F.max(c("md")).alias("max_error"), F.sqrt(F.sum(c("dd")) / F.sum(c("xx"))).alias("rel_l2"),
        F.avg(cos).alias("cos_mean"), F.stddev_pop(cos).alias("cos_std"), (F.sum(c("flip")) / n).alias("sign_flips"), (F.sum(c("zero")) / n).alias("zeros"),
        (F.sum(c("dd")) / n).alias("mse"), (10 * F.log10((F.sum(c("xx")) / n) / (F.sum(c("dd")) / n + 1e-8))).alias("snr_db"), n.alias("n"),
    )


def merge_error_stats(parts: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of the parts as one: means weighted by n, largest and smallest."""
    n = F.col("n")
    return parts.groupBy(*by).agg((F.sum(F.col("mae") * n) / F.sum(n)).alias("mae"), F.max("max_error").alias("max_error"), F.min("cos_mean").alias("worst_cos"), F.sum(n).alias("n"))


def outliers(rows: DataFrame, value: str, by: list[str], width: float = 3.0) -> DataFrame:
    """Number and share of values beyond mean +- width sample deviations, and the bounds. The group's statistics are joined, not windowed."""
    stats = rows.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    far = F.abs(F.col(value) - F.col("m")) > width * F.col("s")
    return rows.join(stats, by).groupBy(*by).agg(F.count_if(far).alias("outliers"), (F.count_if(far) / F.count("*")).alias("share"), F.max(F.col("m") + width * F.col("s")).alias("upper"), F.min(F.col("m") - width * F.col("s")).alias("lower"))


BLOCK = 4096
"""Rows of a layer quantised at once."""


def _feedback(w: np.ndarray, h: np.ndarray, bits: int, damping: float) -> tuple[np.ndarray, np.ndarray]:
    """(w with error feedback under x'x = h, w plainly rounded), each row by itself."""
    h = h + np.eye(len(h)) * (damping * h.diagonal().mean() + 1e-9)
    u = np.linalg.cholesky(np.linalg.inv(h)).T
    most = 2 ** (bits - 1) - 1
    s = np.maximum(np.abs(w).max(1) / most, FLOOR)
    q, left = np.zeros_like(w), w.copy()
    for j in range(w.shape[1]):
        q[:, j] = np.clip(np.rint(left[:, j] / s), -most, most) * s
        left[:, j + 1 :] -= np.outer((left[:, j] - q[:, j]) / u[j, j], u[j, j + 1 :])
    return q, np.clip(np.rint(w / s[:, None]), -most, most) * s[:, None]


def gptq(layers: DataFrame, bits: int = 4, damping: float = 0.01) -> DataFrame:
    """(layer, mse, rounded_mse): error-feedback quantisation of each layer's weights against its inputs, and plain rounding beside it.

    ``layers``: layer, weights array<array<double>> (out x in), inputs array<array<double>> (n x in); a layer a row, quantised in one task.
    """

    def one(batches):
        for b in batches:
            out = []
            for layer, w, x in zip(b.layer, b.weights, b.inputs):
                w, x = np.stack(w).astype(float), np.stack(x).astype(float)
                q, plain = _feedback(w, x.T @ x, bits, damping)
                out.append((layer, float(np.mean((x @ (w - q).T) ** 2)), float(np.mean((x @ (w - plain).T) ** 2))))
            yield pd.DataFrame(out, columns=["layer", "mse", "rounded_mse"])

    return layers.select("layer", "weights", "inputs").mapInPandas(one, "layer string, mse double, rounded_mse double")


def gptq_rows(rows: DataFrame, bits: int = 4, damping: float = 0.01) -> DataFrame:
    """(layer, mse, rounded_mse) as ``gptq`` where all vectors of a layer are weights and inputs; ``rows``: layer string, id, v.

    x'x is summed by parts and the vectors are quantised in blocks of about BLOCK rows, so no layer is collected. Null vectors are left out.
    """
    rows = rows.filter("v is not null").select("layer", "id", doubles(F.col("v")).alias("v"))

    def parts(batches):
        sums: dict[str | None, np.ndarray] = {}
        for b in batches:
            for layer, vs in b.groupby("layer", dropna=False).v:
                x = np.stack(vs.to_numpy())
                layer = layer if isinstance(layer, str) else None
                sums[layer] = sums.get(layer, 0) + x.T @ x
        for layer, h in sums.items():
            yield pd.DataFrame({"layer": pd.Series([layer] * h.size, dtype=object), "i": np.arange(h.size, dtype=np.int32), "x": h.ravel()})

    cells = rows.select("layer", "v").mapInPandas(parts, "layer string, i int, x double").groupBy("layer", "i").agg(F.sum("x").alias("x"))
    h = cells.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("h")).select("layer", F.col("h.x").alias("h"))
    n = rows.groupBy("layer").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    both = h.alias("h").join(n.alias("n"), F.expr("h.layer <=> n.layer")).select("h.layer", "h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    x = rows.alias("r").join(F.broadcast(n).alias("n"), F.expr("r.layer <=> n.layer")).select("r.layer", "v", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))

    def one(w, hs):
        if not len(w):
            return pd.DataFrame({"layer": [], "n": [], "e": [], "r": []})
        v, m = np.stack(w.v.to_numpy()), np.asarray(hs.h[0])
        m = m.reshape(v.shape[1], -1)
        e, r = (float(np.einsum("ij,jk,ik->", d, m, d, optimize=True)) for d in (v - q for q in _feedback(v, m, bits, damping)))
        return pd.DataFrame({"layer": [w.layer[0]], "n": [len(v)], "e": [e], "r": [r]})

    keys = ("layer", "block")
    done = x.groupBy(*keys).cogroup(both.groupBy(*keys)).applyInPandas(one, "layer string, n long, e double, r double")
    total = F.sum("n")
    return done.groupBy("layer").agg((F.sum("e") / total / total).alias("mse"), (F.sum("r") / total / total).alias("rounded_mse"))
