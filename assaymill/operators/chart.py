"""Geometry of charts: gridlines, coloured series, values by interpolation between ticks."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.functions.quantiles import grouped_quantiles

# Gridlines are grey (channels apart by 12 at most) of a brightness from 200 to below 246, over half the
# width; series have channels apart by more than 30, a brightness below 240, and 0.003 of all pixels; bins of colours
# are 24 wide, colours within 35 in each channel are one, and a chart has four series at most.
GRID_SPREAD, GRID_LOW, GRID_HIGH, GRID_WIDTH = 12, 200, 246, 0.5
COLOUR_SPREAD, COLOUR_BRIGHT, COLOUR_SHARE = 30, 240, 0.003
COLOUR_BIN, COLOUR_NEAR, MOST_SERIES = 24, 35, 4
# Ink of a series has channels apart by more than 15; a marker's end is its last 3 columns; the line is
# followed over 80 columns from 16 before the end, by 4 pixels a column at most, and read 8 before the end; residuals
# up to 0.8, or three medians, stay in the second fit if seven tenths of the points do.
INK_SPREAD, CAP_COLUMNS = 15, 3
LINE_SPAN, LINE_SKIP, LINE_HALF, LINE_STEP = 80, 16, 8, 4.0
TRIM_LEAST, TRIM_MEDIANS, TRIM_SHARE = 0.8, 3.0, 0.7


def spread(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def is_grid(r: Column, g: Column, b: Column) -> Column:
    bright = (r + g + b) / 3
    return (spread(r, g, b) <= GRID_SPREAD) & (bright >= GRID_LOW) & (bright < GRID_HIGH)


def is_coloured(r: Column, g: Column, b: Column) -> Column:
    return (spread(r, g, b) > COLOUR_SPREAD) & ((r + g + b) / 3 < COLOUR_BRIGHT)


def islands(rows: DataFrame, key: list[str], order: str, gap: float) -> DataFrame:
    """Adds island: rows of a key whose order values follow one another by at most ``gap`` share a number."""
    w = W.partitionBy(*key).orderBy(order)
    starts = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return rows.withColumn("island", F.sum(F.coalesce(starts, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def gridlines(pixels: DataFrame) -> DataFrame:
    """pixels: img, y, x, r, g, b. img, line (from the top), y: rows more than half grey, within two of each other one line."""
    c = F.col
    rows = pixels.groupBy("img", "y").agg(F.count_if(is_grid(c("r"), c("g"), c("b"))).alias("grey"), F.count("*").alias("width"))
    rows = rows.where(c("grey") > GRID_WIDTH * c("width"))
    lines = islands(rows, ["img"], "y", 2).groupBy("img", "island").agg(F.round(F.avg("y"), 1).alias("y"))
    return lines.withColumn("line", F.row_number().over(W.partitionBy("img").orderBy("y"))).drop("island")


def ticked(lines: DataFrame, ticks: DataFrame) -> DataFrame:
    """ticks: img, value, in any order. The largest belongs to the top line, and so on; only where their numbers agree."""
    lines = lines.withColumn("n", F.count("*").over(W.partitionBy("img")))
    by_value = W.partitionBy("img").orderBy(F.desc("value"))
    marks = ticks.withColumns({"line": F.row_number().over(by_value), "m": F.count("*").over(W.partitionBy("img"))})
    return lines.join(marks, ["img", "line"]).where("n = m").select("img", "line", "y", "value")


def interpolate(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points: img, series, py. marks: img, y, value. The value at py between the two lines around it; beyond
    the outermost by the nearest pair; one decimal."""
    w = W.partitionBy("img").orderBy("y")
    pairs = marks.withColumns(
        {"y2": F.lead("y").over(w), "v2": F.lead("value").over(w), "n": F.row_number().over(w)}
    ).where("y2 is not null")
    last = F.max("n").over(W.partitionBy("img"))
    pairs = pairs.withColumns({"low": F.when(F.col("n") == 1, float("-inf")).otherwise(F.col("y")), "high": F.when(F.col("n") == last, float("inf")).otherwise(F.col("y2"))})
    joined = points.join(pairs, "img").where((F.col("py") >= F.col("low")) & (F.col("py") < F.col("high")))
    value = F.col("value") + (F.col("py") - F.col("y")) * (F.col("v2") - F.col("value")) / (F.col("y2") - F.col("y"))
    return joined.select("img", "series", "py", F.round(value, 1).alias("value"))


def colour_bins(pixels: DataFrame) -> DataFrame:
    """Coloured pixels by bins of their channels: img, the bin, pixels and the mean colour (whole numbers), for bins
    with enough pixels to be a drawn line."""
    c = F.col
    rows = pixels.select("img", *[c(k) for k in "rgb"], is_coloured(c("r"), c("g"), c("b")).alias("ink"))
    area = rows.groupBy("img").agg(F.count("*").alias("area"))
    bins = {f"{k}_bin": F.floor(c(k) / COLOUR_BIN) for k in "rgb"}
    found = rows.where("ink").withColumns(bins).groupBy("img", *bins).agg(F.count("*").alias("pixels"), *[F.floor(F.avg(k)).alias(k) for k in "rgb"])
    return found.join(area, "img").where(c("pixels") >= COLOUR_SHARE * c("area")).drop("area")


def largest_colours(bins: DataFrame, most: int = MOST_SERIES) -> DataFrame:
    """Of each image the colours of its series, the one with most pixels first; a bin whose colour is near one that is
    taken already is part of it. Images have at most 1 / COLOUR_SHARE bins."""
    bins_of = F.array_sort(F.collect_list(F.struct((-F.col("pixels")).alias("less"), "r_bin", "g_bin", "b_bin", "pixels", "r", "g", "b")))
    near = lambda x, y: F.greatest(*[F.abs(x[k] - y[k]) for k in "rgb"]) <= COLOUR_NEAR
    step = lambda taken, x: F.when((F.size(taken) < most) & ~F.exists(taken, lambda y: near(x, y)), F.concat(taken, F.array(x))).otherwise(taken)
    whole = bins.groupBy("img").agg(bins_of.alias("all"))
    whole = whole.select("img", F.aggregate("all", F.slice("all", 1, 0), step).alias("taken"))
    kept = whole.select("img", F.posexplode("taken").alias("at", "c"))
    return kept.select("img", *[F.col(f"c.{k}").alias(k) for k in ("r_bin", "g_bin", "b_bin", "pixels", "r", "g", "b")], (F.col("at") + 1).alias("place"))


def line_ends(track: DataFrame) -> DataFrame:
    """track: img, series, x, y of a series' ink. The right end: the largest x and the middle of the y of the last columns."""
    top = track.withColumn("right", F.max("x").over(W.partitionBy("img", "series"))).where(F.col("x") >= F.col("right") - CAP_COLUMNS)
    return top.groupBy("img", "series").agg(F.max("right").alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y"))


def trimmed_fit(points: DataFrame, *keys: str) -> DataFrame:
    """points: keys, x, y. Least squares, then once more without points further off than three median residuals (or
    0.8, if that is more); the first fit where fewer than seven tenths of the points, or than two, would stay.

    Groups may have any size: each step is an aggregation that is combined before the shuffle, or a join.
    """
    fit = [F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")]
    points = points.select(*keys, "x", "y")
    first = points.groupBy(*keys).agg(*fit, F.count("*").alias("all"))
    off = F.abs(F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x")))
    rows = points.join(first, list(keys)).withColumn("off", off)
    median = grouped_quantiles(rows, list(keys), "off", [0.5]).select(*keys, F.greatest(F.lit(TRIM_LEAST), TRIM_MEDIANS * F.get("q", 0)).alias("most"))
    second = rows.join(median, list(keys)).where("off <= most").groupBy(*keys).agg(*fit, F.count("*").alias("n"))
    both = first.alias("f").join(second.alias("s"), list(keys), "left")
    again = (F.col("s.n") >= TRIM_SHARE * F.col("f.all")) & (F.col("s.n") >= 2)
    chosen = lambda c, d: F.when(again, F.col(f"s.{c}")).otherwise(F.col(f"f.{d}"))
    return both.select(*keys, chosen("n", "all").alias("n"), chosen("slope", "slope").alias("slope"), chosen("intercept", "intercept").alias("intercept"))


def assign(estimates: DataFrame, measured: DataFrame, most: int = 6) -> DataFrame:
    """estimates: img, label, estimate. measured: img, value. The pairing with the least total difference.

    Charts have few series, so every order of the measured values is tried within a row; ties go to the
    first order. With more than ``most`` series both sides are paired in the order of their values, which has the
    least total difference, too. Charts whose counts differ give no pairs.
    """
    a = estimates.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("label", "estimate"))).alias("e"))
    b = measured.groupBy("img").agg(F.array_sort(F.collect_list("value")).alias("v"))
    both = a.join(b, "img").where(F.size("e") == F.size("v"))
    orders = F.create_map(
        *[x for n in range(1, most + 1) for x in (F.lit(n), F.array(*[F.array(*map(F.lit, p)) for p in itertools.permutations(range(n))]))]
    )
    def priced(order: Column) -> Column:
        cost = F.aggregate(F.zip_with("e", order, lambda e, i: F.abs(e["estimate"] - F.get("v", i))), F.lit(0.0), lambda s, x: s + x)
        return F.struct(F.round(cost, 9).alias("cost"), order.alias("order"))
    best = F.array_min(F.transform(F.element_at(orders, F.least(F.size("e"), F.lit(most))), priced))
    by_value = F.transform(F.array_sort(F.transform("e", lambda x, i: F.struct(x["estimate"].alias("v"), i.alias("i")))), lambda x, k: F.struct(x["i"].alias("i"), k.alias("k")))
    in_order = F.transform(F.array_sort(by_value), lambda x: x["k"])
    best = F.when(F.size("e") <= most, best).otherwise(F.struct(F.lit(0.0).alias("cost"), in_order.alias("order")))
    pairs = F.transform("best.order", lambda i, k: F.struct(F.get("e", k)["label"].alias("label"), F.get("e", k)["estimate"].alias("estimate"), F.get("v", i).alias("value")))
    return both.withColumn("best", best).select("img", F.inline(pairs))


def match_labels(measured: DataFrame, read: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Both: img, label, value. Per chart: all_agree within the tolerance, worst (two decimals), and unmatched
    labels. Labels match exactly, else if one contains the other, whatever the case."""
    m = measured.select("img", F.lower("label").alias("a"), F.col("value").alias("va"))
    r = read.select("img", F.lower("label").alias("b"), F.col("value").alias("vb"))
    near = m.join(r, "img").where(F.contains("a", F.col("b")) | F.contains("b", F.col("a")))
    best = near.groupBy("img", "a", "va").agg(F.max_by("vb", F.struct(F.col("a") == F.col("b"), "b")).alias("vb"))
    rows = m.join(best, ["img", "a", "va"], "left")
    delta = F.abs(F.col("va") - F.col("vb"))
    return rows.groupBy("img").agg(
        F.count("*").alias("labels"), F.count_if(F.col("vb").isNull()).alias("unmatched"),
        F.when(F.count_if(F.col("vb").isNull()) == 0, F.bool_and(delta <= tolerance)).alias("all_agree"),
        F.round(F.max(delta), 2).alias("worst"),
    )


def series_colours(rgb: np.ndarray) -> list[np.ndarray]:
    """As :func:`largest_colours`, of one image."""
    ink = (rgb.max(2) - rgb.min(2) > COLOUR_SPREAD) & (rgb.mean(2) < COLOUR_BRIGHT)
    bins, of, counts = np.unique(rgb[ink] // COLOUR_BIN, axis=0, return_inverse=True, return_counts=True)
    taken: list[np.ndarray] = []
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] < COLOUR_SHARE * rgb.shape[0] * rgb.shape[1] or len(taken) == MOST_SERIES:
            break
        mean = np.floor(rgb[ink][of.ravel() == k].mean(0))
        if all(abs(mean - t).max() > COLOUR_NEAR for t in taken):
            taken.append(mean)
    return taken


def run_centres(ink: np.ndarray) -> list[np.ndarray]:
    """The middles of all runs of ink, column by column."""
    edges = np.diff(np.pad(ink.astype(np.int8), ((1, 1), (0, 0))), axis=0).T
    (columns, starts), (_, ends) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    return np.split((starts + ends - 1) / 2, np.searchsorted(columns, np.arange(1, ink.shape[1])))


def trail(columns: list[np.ndarray], y: float) -> np.ndarray:
    """From ``y`` through the columns, in each the middle nearest to the one before, as far as none lies too far."""
    found = []
    for middles in columns:
        nearest = middles[np.argmin(abs(middles - y))] if len(middles) else np.inf
        if abs(nearest - y) > LINE_STEP:
            break
        found.append(y := float(nearest))
    return np.array(found)


def trimmed_line(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """A line through the points, and once more through those near it if enough of them are."""
    line = np.polyfit(xs, ys, 1)
    off = abs(np.polyval(line, xs) - ys)
    keep = off <= max(TRIM_LEAST, TRIM_MEDIANS * np.median(off))
    return np.polyfit(xs[keep], ys[keep], 1) if keep.sum() >= max(2, TRIM_SHARE * len(xs)) else line


def end_of_line(ink: np.ndarray) -> float:
    """The row at which a series ends: by a line through what leads to its marker, else the marker's middle."""
    right = int(np.flatnonzero(ink.any(0)).max())
    cap = np.flatnonzero(ink[:, max(0, right - CAP_COLUMNS) : right + 1].any(1))
    middle = (cap.min() + cap.max()) / 2
    clear = right - LINE_SKIP  # of the marker
    columns = run_centres(ink)[max(0, clear - LINE_SPAN + 1) : max(0, clear + 1)]
    ys = trail(columns[::-1], middle)
    if len(ys) < LINE_SPAN // 2:
        return float(middle)
    return float(np.polyval(trimmed_line(clear - np.arange(len(ys), dtype=float), ys), right - LINE_HALF))


def measure_image(rgb: np.ndarray, ticks: list[float]) -> list[tuple[int, int, float]]:
    """Series of a chart and the value at their right end, one decimal: place, pixels, value. None where the chart
    doesn't resolve: fewer than two gridlines, or not as many as ticks, or a colour without ink."""
    low, high, bright = rgb.min(2), rgb.max(2), rgb.mean(2)
    grey = (high - low <= GRID_SPREAD) & (bright >= GRID_LOW) & (bright < GRID_HIGH)
    rows = np.flatnonzero(grey.sum(1) > GRID_WIDTH * rgb.shape[1])
    lines = [round(float(g.mean()), 1) for g in np.split(rows, np.flatnonzero(np.diff(rows) > 2) + 1)] if len(rows) else []
    values = sorted(ticks, reverse=True)
    if len(lines) != len(values) or len(lines) < 2:
        return []
    out = []
    for place, colour in enumerate(series_colours(rgb), 1):
        ink = (abs(rgb - colour).max(2) <= COLOUR_NEAR) & (high - low > INK_SPREAD)
        if not ink.any():
            return []
        end = end_of_line(ink)
        i = int(np.clip(np.searchsorted(lines, end) - 1, 0, len(lines) - 2))
        value = values[i] + (end - lines[i]) * (values[i + 1] - values[i]) / (lines[i + 1] - lines[i])
        out.append((place, int(ink.sum()), round(float(value), 1)))
    return out


def measure_charts(pixels: DataFrame, ticks: DataFrame) -> DataFrame:
    """pixels: img, y, x, r, g, b. ticks: img, ticks (array). img, series, pixels, value of every chart.

    Following a line needs the columns in order, so each image is worked on as a whole; an image is small.
    """
    packed = pixels.groupBy("img").agg(F.collect_list(F.struct("y", "x", "r", "g", "b")).alias("p"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for img, pixels_, ticks_ in f.itertuples(index=False):
                at = np.array([(p["y"], p["x"], p["r"], p["g"], p["b"]) for p in pixels_])
                rgb = np.full((at[:, 0].max() + 1, at[:, 1].max() + 1, 3), 255)
                rgb[at[:, 0], at[:, 1]] = at[:, 2:]
                out += [(img, *s) for s in measure_image(rgb, list(ticks_))]
            yield pd.DataFrame(out, columns=["img", "series", "pixels", "value"])

    return packed.join(ticks, "img").select("img", "p", "ticks").mapInPandas(work, "img long, series int, pixels long, value double")


def decode_png(data: bytes) -> np.ndarray:
    """Rows, columns and RGB (0 to 255) of a PNG image of 8 bits a channel that isn't interlaced: grey, RGB or palette,
    with or without an alpha channel, which is left out. Anything else is an error."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, head, packed, palette = 8, None, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, "u1").reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only 8 bits a channel, not interlaced")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), "u1").reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), "u1")
    above = np.zeros(width * channels, "u1")
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:  # the pixel to the left, added up along each channel
            out[y] = np.cumsum(line.reshape(width, channels), axis=0, dtype="u1").ravel()
        elif kind == 2:
            out[y] = line + above
        else:
            out[y] = _filtered(line.astype(int), above.astype(int), channels, kind)
        above = out[y]
    pixels = out.reshape(height, width, channels).astype(int)
    if colour == 3:
        return palette[pixels[:, :, 0]].astype(int)
    return pixels[:, :, :3] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def _filtered(line: np.ndarray, above: np.ndarray, step: int, kind: int) -> list[int]:
    """A row whose bytes are coded by the mean of the left and upper byte (3), or by the nearest of left, upper and
    upper left to their plane (4)."""
    out: list[int] = []
    for i, x in enumerate(line.tolist()):
        left, corner = (out[i - step], int(above[i - step])) if i >= step else (0, 0)
        up = int(above[i])
        if kind == 3:
            guess = (left + up) // 2
        elif kind == 4:
            plane = left + up - corner
            guess = min((left, up, corner), key=lambda c: abs(c - plane))
        else:
            raise ValueError("unknown filter")
        out.append((x + guess) & 255)
    return out


def measure_pngs(images: DataFrame, ticks: DataFrame) -> DataFrame:
    """images: img, png (binary, as of Spark's binaryFile source). ticks: img, ticks (array). As :func:`measure_charts`;
    an image that can't be decoded gives no row."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for img, png, ticks_ in f.itertuples(index=False):
                try:
                    rgb = decode_png(png)
                except (ValueError, IndexError, TypeError, struct.error, zlib.error):
                    continue
                out += [(img, *s) for s in measure_image(rgb, list(ticks_))]
            yield pd.DataFrame(out, columns=["img", "series", "pixels", "value"])

    return images.join(ticks, "img").select("img", "png", "ticks").mapInPandas(work, "img long, series int, pixels long, value double")


# Fixed value: the line that stands above measured values on a page.
MEASURED = "[Measured from the chart's pixels - authoritative over the estimates above]"


def measured_text(series: DataFrame) -> DataFrame:
    """series: img, label, value. The block that is appended to a page: its marker once, then a line for each series."""
    rows = F.array_sort(F.collect_list(F.struct("label", "value")))
    lines = F.transform(rows, lambda s: F.concat(s["label"], F.lit(": "), F.round(s["value"], 1).cast("decimal(20,1)").cast("string"), F.lit("% (measured off the axis)")))
    return series.groupBy("img").agg(F.concat_ws("\n", F.lit(MEASURED), F.array_join(lines, "\n")).alias("text"))


def needs_chart_path(text: Column) -> Column:
    """A page without any percentage or amount is read from its charts."""
    from assaymill.functions.text import NUMERIC

    return ~F.coalesce(text, F.lit("")).rlike(NUMERIC)


def read_pages(pages: DataFrame, charts: DataFrame) -> DataFrame:
    """pages: doc_id, page_number, text. charts: the same keys, has_read, has_values (booleans) and measured. The page's
    own text where it has numbers, else with the measured block; what is left open has a reason: no chart, a
    chart that wasn't read, one whose geometry or whose labels did not resolve."""
    joined = pages.join(charts.withColumn("has_chart", F.lit(True)), ["doc_id", "page_number"], "left")
    open_ = needs_chart_path(F.col("text"))
    stripped = F.regexp_replace("text", r"\s+$", "")
    text = F.when(open_ & F.col("measured").isNotNull(), F.concat(F.coalesce(stripped, F.lit("")), F.lit("\n\n"), "measured")).otherwise(F.col("text"))
    reason = (
        F.when(~open_ | F.col("measured").isNotNull(), None)
        .when(F.col("has_chart").isNull(), "no chart on the page")
        .when(~F.col("has_read"), "the chart was not read")
        .when(~F.col("has_values"), "the chart's geometry did not resolve")
        .otherwise("labels and series did not match")
    )
    method = F.when(open_, "vision").otherwise("textlayer")
    return joined.select("doc_id", "page_number", text.alias("text"), method.alias("method"), reason.alias("unresolved"))
