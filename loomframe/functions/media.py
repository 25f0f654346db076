"""Column functions over timed records: timestamps, codec names, quantisers, bit tricks and header rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"

# Four-character codes of sample entries, and the names of the codecs they stand for.
CODECS = {"avc1": "h264", "avc3": "h264", "hvc1": "h265", "hev1": "h265", "av01": "av1", "vp09": "vp9", "mp4a": "aac", "Opus": "opus", "fLaC": "flac"}
VIDEO, AUDIO = ("h264", "h265", "av1", "vp9"), ("aac", "opus", "flac")
HANDLERS = {"vide": "video", "soun": "audio"}
PRESETS = {"slowest": 0, "medium": 6, "fastest": 10}
# Bits per pixel and planes of pixel formats.
PIXEL_FORMATS = {"yuv420p": (12, 3), "yuv422p": (16, 3), "yuv444p": (24, 3), "rgb24": (24, 1), "bgr24": (24, 1)}


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone, read as UTC."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def rescale(value: Column, num: int, den: int, to_num: int, to_den: int) -> Column:
    """Ticks of num/den seconds as ticks of to_num/to_den, cut towards zero; null if a base is invalid or the value is null."""
    if not (den and to_num and num and to_den):
        return F.lit(None).cast("long")
    scaled = value.cast(WIDE) * F.lit(num * to_den).cast("decimal(18,0)")
    divisor = F.lit(den * to_num).cast("decimal(18,0)")
    return ((scaled - scaled % divisor) / divisor).cast("long")


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient cut towards zero, null when b is 0."""
    b = F.lit(b) if isinstance(b, int) else b
    quotient = (a - a % b) / F.when(b != 0, b)
    return F.round(quotient).cast("long")


def codec_of(fourcc: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CODECS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, fourcc), F.lit("unknown"))


def media_type(codec: Column) -> Column:
    return F.when(codec.isin(*VIDEO), "video").when(codec.isin(*AUDIO), "audio").otherwise("other")


def media_of_handler(handler: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in HANDLERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, handler), F.lit("other"))


def preset_speed(name: Column, custom: Column) -> Column:
    out = F.least(custom.cast("int"), F.lit(10))
    for preset, speed in PRESETS.items():
        out = F.when(name == preset, F.lit(speed)).otherwise(out)
    return out


def frame_bytes(width: Column, height: Column, pixel_format: Column) -> Column:
    """Bytes of a frame, rounded up; null for an unknown format or when the product overflows."""
    bits = F.create_map(*[F.lit(x) for name, (b, _) in PIXEL_FORMATS.items() for x in (name, b)])
    return F.floor((F.try_multiply(F.try_multiply(width.cast("long"), height.cast("long")), F.try_element_at(bits, pixel_format).cast("long")) + 7) / 8).cast("long")


def zigzag(r: Column) -> Column:
    """0, -1, 1, -2, 2 to 0, 1, 2, 3, 4."""
    return F.when(r >= 0, r * 2).otherwise(-r * 2 - 1)


def unzigzag(m: Column) -> Column:
    return F.when(m % 2 == 0, F.shiftright(m, 1)).otherwise(-F.shiftright(m + 1, 1))


def bit_length(v: Column) -> Column:
    """Bits of a number that isn't negative; 0 for 0."""
    return F.when(v <= 0, F.lit(0)).otherwise(F.length(F.bin(v)))


def rice_parameter(left: Column, up: Column) -> Column:
    return F.least(F.shiftright(bit_length(left) + bit_length(up) + 1, 1), F.lit(15)).cast("int")


def quantize(v: Column, step: int) -> Column:
    """Half away from zero."""
    return F.signum(v.cast("double")).cast("long") * F.floor((F.abs(v) * 2 + step) / (2 * step)).cast("long")


_SPREAD = [sum((v >> k & 1) << 3 * k for k in range(5)) for v in range(32)]


def spread_bits(v: Column) -> Column:
    """Ten bits, two zero bits after each: five at a time by a table, so that expressions that nest this stay small."""
    table = F.expr(f"array({', '.join(f'{x}L' for x in _SPREAD)})")
    five = lambda shift: F.get(table, F.shiftright(v.cast("long"), shift).bitwiseAND(31).cast("int"))
    return five(0).bitwiseOR(F.shiftleft(five(5), 15))


def morton(x: Column, y: Column, z: Column) -> Column:
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1)).bitwiseOR(F.shiftleft(spread_bits(z), 2))


def grid_coordinate(v: Column, depth: int) -> Column:
    """A coordinate of 0 to 1 on a grid of 2^depth cells; others are clamped."""
    cells = 1 << depth
    return F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * cells), F.lit(cells - 1)).cast("long")


def foveated_qp(base: Column, col: Column, row: Column, cols: int, rows: int, cx: float, cy: float, most: int = 18) -> Column:
    """Quality step by the distance of a cell from the gaze point (cx, cy, in cells), in half grids; at most ``most`` over base, within 0 to 51."""
    dx, dy = (col - F.lit(cx)) / F.lit(cols / 2), (row - F.lit(cy)) / F.lit(rows / 2)
    away = F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy))
    return F.greatest(F.lit(0), F.least(F.lit(51), base.cast("int") + F.round(away * most).cast("int")))


def refresh_mask(frame: Column, rows: int, per_frame: int) -> Column:
    """Bit mask of the rows that frame renews: a window of ``per_frame`` rows that moves on and wraps."""
    start = (frame % rows) * per_frame % rows
    out = F.lit(0).cast("long")
    for k in range(per_frame):
        row = (start + k) % rows
        out = out.bitwiseOR(F.pow(F.lit(2.0), row).cast("long"))
    return out


def decode_ms(pixels: Column, slices: Column, per_pixel_ns: int = 5, per_slice_ns: int = 2000) -> Column:
    return F.floor((pixels * per_pixel_ns + slices * per_slice_ns) / 1_000_000).cast("long")


def deadline_action(deadline: Column, elapsed: Column, qp: Column) -> Column:
    """keep; skip_refinement for a slip under 8 ms or when the step can't be raised; raise_qp:<delta> else."""
    over = elapsed - deadline
    delta = F.least(qp + F.least(F.floor(over / 8), F.lit(16)), F.lit(51)) - qp
    return F.when(over <= 0, "keep").when((over < 8) | (delta <= 0), "skip_refinement").otherwise(F.concat(F.lit("raise_qp:"), delta.cast("int").cast("string")))


def implicit_weight(current: Column, first: Column, second: Column) -> Column:
    """Weight, of 64, of the second reference by distances in display order; 32 where none can be derived."""
    clamp = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), v))
    td, tb = clamp(second - first, -128, 127), clamp(current - first, -128, 127)
    tx = int_div(F.floor(F.abs(td) / 2) + 16384, td)
    factor = clamp(F.floor((tb * tx + 32) / 64), -1024, 1023)
    w = F.floor(factor / 4).cast("long")
    return F.when(first == second, F.lit(32).cast("long")).when((w < -64) | (w > 128), F.lit(32).cast("long")).otherwise(w)


def median_of(a: Column, b: Column, c: Column) -> Column:
    return F.array_sort(F.array(a, b, c))[1]


def gradient_predictor(left: Column, up: Column, corner: Column) -> Column:
    """left + up - corner, raised to left if under it, else cut to up; missing neighbours (null) give the other one, or 0."""
    p = left + up - corner
    return F.when(left.isNull() & up.isNull(), F.lit(0)).when(left.isNull(), up).when(up.isNull(), left).when(p < left, left).when(p > up, up).otherwise(p)


def segment_name(index: Column) -> Column:
    return F.format_string("segment%05d.ts", index)


def identifier(name: Column) -> Column:
    """A valid name: other signs become underscores, the first letter is upper case, leading digits and underscores go."""
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")
    clean = F.concat(F.translate(F.substring(clean, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(clean, F.lit(2)))
    clean = F.regexp_replace(clean, "^[_0-9]+", "")
    return F.when(clean == "", F.concat(F.lit("State_"), name)).otherwise(clean)


def all_of(rules: Sequence[Column]) -> Column:
    out = F.lit(True)
    for rule in rules:
        out = out & F.coalesce(rule, F.lit(False))
    return out


def header_valid(bit_depth: Column, block_log2: Column, references: Column, is_key: Column) -> Column:
    """Rules of coded headers: depth 8, 10, 12 or 16; blocks of 2^3 to 2^6; no references for key frames, one or more for others."""
    return all_of([bit_depth.isin(8, 10, 12, 16), block_log2.between(3, 6), F.when(is_key, references == 0).otherwise(references >= 1)])


def seconds(value: Column, num: int, den: int) -> Column:
    """Seconds of ticks of num/den; not a number where the value is null or the base has no denominator."""
    return F.lit(float("nan")) if not den else F.coalesce(value.cast("double") * F.lit(num / den), F.lit(float("nan")))


def display_time(value: Column, num: int, den: int) -> Column:
    """Seconds to three places with the ticks and their base, or NOPTS."""
    return F.when(value.isNull(), "NOPTS").otherwise(F.format_string("%.3fs (%d/%d @ %d/%d)", seconds(value, num, den), value, F.lit(den), F.lit(num), F.lit(den)))


def samples_per_channel(n_bytes: Column, sample_bytes: int, channels: Column) -> Column:
    return F.floor(n_bytes / (F.greatest(channels, F.lit(1)) * sample_bytes)).cast("long")


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down; null when b is 0."""
    r = a % F.when(b != 0, b)
    return int_div(a, b) - F.when((r != 0) & ((r < 0) != (b < 0)), 1).otherwise(0)


def euclid_div(a: Column, b: Column) -> Column:
    """The quotient whose remainder isn't negative; null when b is 0."""
    r = a % F.when(b != 0, b)
    return int_div(a, b) - F.when(r < 0, F.signum(b.cast("double")).cast("long")).otherwise(0)


def round_div(a: Column, b: Column) -> Column:
    """Quotient by a positive number, halves away from zero."""
    half = floor_div(b, F.lit(2))
    return int_div(F.when(a >= 0, a + half).otherwise(a - half), b)


def quantize_power(v: Column, qp: int, precision: int) -> Column:
    """By steps of 2^-(qp + precision), halves away from zero."""
    scaled = v * F.lit(2.0 ** (qp + precision))
    return (F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)).cast("long")


def dequantize_power(q: Column, qp: int, precision: int) -> Column:
    return q * F.lit(2.0 ** -(qp + precision))


def dequantize_spectral(q: Column, gain: Column, scale: Column) -> Column:
    """sign(q) |q|^(4/3) 2^((gain - 100 - scale) / 4)."""
    return F.signum(q.cast("double")) * F.pow(F.abs(q).cast("double"), F.lit(4 / 3)) * F.pow(F.lit(2.0), (gain - 100 - scale) / 4)


def dequantize_clipped(q: Column, step: Column, shift: int) -> Column:
    """q step cut to 24 bits, divided by 2^shift towards zero, within 16 bits with sign."""
    product = q * step
    size = F.shiftright(F.abs(product).bitwiseAND(0xFFFFFF), shift)
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.when(product < 0, -size).otherwise(size)))


def child_index(x: Column, y: Column, z: Column, level: int, depth: int) -> Column:
    """Which of a cell's eight children, on a level of a tree of ``depth`` levels, holds a grid point."""
    bit = lambda v: F.shiftright(v, depth - 1 - level).bitwiseAND(1)
    return bit(x) + bit(y) * 2 + bit(z) * 4


def is_refreshed(frame: Column, row: Column, rows: int, per_frame: int) -> Column:
    """True if a frame renews a row; rows beyond the picture never are."""
    start = (frame % rows) * per_frame % rows
    return row.between(0, rows - 1) & ((row - start + rows) % rows < per_frame)


def median_vector(x: Sequence[Column], refs: Sequence[Column], ref: Column) -> Column:
    """One component of a predicted vector from three neighbours (null if missing): that of the only one with the
    reference; else the first if the others are missing; else the median, missing ones as 0."""
    hit = [F.coalesce(r == ref, F.lit(False)) for r in refs]
    n = sum((h.cast("int") for h in hit), F.lit(0))
    zero = [F.coalesce(v, F.lit(0)) for v in x]
    only = F.when(hit[0], x[0]).when(hit[1], x[1]).otherwise(x[2])
    return F.when(n == 1, only).when(x[1].isNull() & x[2].isNull() & x[0].isNotNull(), x[0]).otherwise(median_of(*zero))


def clip_pixel(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def weighted(p: Column, weight: Column, offset: Column, log_wd: int) -> Column:
    """A prediction from one reference with a weight of 2^log_wd parts and an offset."""
    scaled = F.shiftright(p * weight + (1 << log_wd - 1), log_wd) if log_wd else p * weight
    return clip_pixel(scaled + offset)


def weighted_pair(p: Column, q: Column, w0: Column, w1: Column, offset0: Column, offset1: Column, log_wd: int) -> Column:
    if not log_wd:
        return clip_pixel(F.shiftright(p * w0 + q * w1 + offset0 + offset1 + 1, 1))
    return clip_pixel(F.shiftright(p * w0 + q * w1 + (1 << log_wd), log_wd + 1) + F.shiftright(offset0 + offset1 + 1, 1))


def average_pair(p: Column, q: Column) -> Column:
    """Rounded up; the other one where one is null."""
    return F.coalesce(F.shiftright(p + q + 1, 1), p, q)


def scaled_vector(v: Column, current: Column, distance: Column) -> Column:
    """A vector over ``distance`` pictures for ``current`` ones, both within a signed byte; itself over none."""
    clamp = lambda d: F.greatest(F.lit(-128), F.least(F.lit(127), d))
    td, tb = clamp(distance).cast("long"), clamp(current).cast("long")
    factor = F.shiftright(tb * int_div(F.shiftright(F.abs(td), 1) + 16384, td) + 32, 6)
    return F.when(distance == 0, v).otherwise(F.shiftright(v * factor + 256, 9))


# Deblocking thresholds by quantiser step, 0 to 51.
ALPHA = (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255)
BETA = (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18)


def threshold(table: Sequence[int], qp: Column, offset: Column) -> Column:
    """A threshold at qp + 2 offset, within the table."""
    at = F.greatest(F.lit(0), F.least(F.lit(len(table) - 1), qp + offset * 2)).cast("int")
    return F.get(F.array(*map(F.lit, table)), at)


def boundary_strength(intra: Column, block_edge: Column, coded: Column, same_reference: Column, dx: Column, dy: Column) -> Column:
    """4 or 3 beside intra blocks (block_edge or not), 2 beside coded residuals, 1 for another reference or a vector 4 off, else 0."""
    return F.when(intra, F.when(block_edge, 4).otherwise(3)).when(coded, 2).when(~same_reference | (F.abs(dx) >= 4) | (F.abs(dy) >= 4), 1).otherwise(0)


def plain_boundary_strength(intra: Column, same_reference: Column, dx: Column, dy: Column) -> Column:
    return F.when(intra, 4).when(~same_reference | (F.abs(dx) >= 4) | (F.abs(dy) >= 4), 1).otherwise(0)


def nearest_predictor(left: Column, up: Column, corner: Column) -> Column:
    """Of left, up and corner that nearest to left + up - corner; left, then up, on ties."""
    to = left + up - corner
    a, b, c = F.abs(to - left), F.abs(to - up), F.abs(to - corner)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def six_tap(x: Sequence[Column]) -> Column:
    """The half sample between the third and the fourth of six."""
    a, b, c, d, e, f = x
    return clip_pixel(F.shiftright(a - b * 5 + c * 20 + d * 20 - e * 5 + f + 16, 5))


def bilinear(p: Column, q: Column, eighths: Column) -> Column:
    return F.shiftright(p * (8 - eighths) + q * eighths + 4, 3)


def linear_congruential(seed: Column, steps: int) -> Column:
    """The state of a 32-bit generator (1103515245, 12345) after so many steps."""
    x = seed.cast("long").bitwiseAND(0xFFFFFFFF)
    for _ in range(steps):
        x = (x * 1103515245 + 12345).bitwiseAND(0xFFFFFFFF)
    return x


def xorshift64(seed: Column, steps: int) -> Column:
    """The state of a 64-bit xorshift generator (13, 7, 17) after so many steps, as a number with sign."""
    x = seed.cast("long")
    for _ in range(steps):
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def is_lost(state: Column, rate: float) -> Column:
    """True if a draw's upper 32 bits are under the rate."""
    return F.shiftrightunsigned(state, 32) < int(rate * 0xFFFFFFFF)


def rotated(x: Column, y: Column, z: Column, angles: Sequence[Column]) -> tuple[Column, Column, Column]:
    """A point turned about the x, then the y, then the z axis."""
    a, b, c = angles
    y, z = y * F.cos(a) - z * F.sin(a), y * F.sin(a) + z * F.cos(a)
    x, z = x * F.cos(b) + z * F.sin(b), z * F.cos(b) - x * F.sin(b)
    return x * F.cos(c) - y * F.sin(c), x * F.sin(c) + y * F.cos(c), z


def text_of(data: Column) -> Column:
    """The text of bytes without closing zeros; what isn't UTF-8 becomes the replacement sign."""
    return F.rtrim(F.make_valid_utf8(data.cast("string")), F.lit("\0"))


def numbers_in(text: Column) -> Column:
    """Whole numbers of a text with their sign, but those that touch a name's letters, digits or underscore."""
    return F.regexp_extract_all(text, F.lit(r"(-?(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_]))"), F.lit(1))


def markers(lines: DataFrame, line: str, prefix: str, required: Sequence[str]) -> DataFrame:
    """Lines behind a prefix as names and values; ``required`` and range become columns, and lines that lack a required name go."""
    pairs = F.str_to_map(F.regexp_replace(F.trim(F.substr(line, F.lit(len(prefix) + 1))), r"\s+", " "), F.lit(" "), F.lit("="))
    marked = lines.filter(F.startswith(F.ltrim(line), F.lit(prefix))).withColumn("_pairs", pairs)
    named = marked.withColumns({name: F.try_element_at("_pairs", F.lit(name)) for name in (*required, "range")})
    return named.filter(all_of([F.col(name).isNotNull() for name in required])).drop("_pairs")


# --- header rules of the coded families


def lean_header(key: Column, references: Column, most_references: Column, least_block: Column, most_block: Column, width: Column, most_width: Column) -> Column:
    """Blocks in order, sizes and references within the sequence's, and none for key frames."""
    return all_of([least_block <= most_block, width <= most_width, references <= most_references, ~key | (references == 0)])


def screen_header(key: Column, references: Column, block_log2: Column, streams: Column, dictionary: Column, palette: Column, glyph: Column, bit_depth: Column) -> Column:
    return all_of([block_log2.between(3, 6), streams >= 4, dictionary >= 1, palette >= 1, glyph.between(1, 64), bit_depth.isin(8, 10), F.when(key, references == 0).otherwise(references >= 1)])


def volumetric_header(version: Column, dynamic: Column, points: Column, depth: Column, coding: Column) -> Column:
    return all_of([version == 1, dynamic == 0, points <= 10_000_000, depth <= 24, coding.isin(0, 1)])


def lossless_header(bit_depth: Column, width: Column, height: Column, n_values: Column) -> Column:
    return all_of([bit_depth.isin(10, 12, 16), n_values == width * height])


def face_header(magic: Column, version: Column) -> Column:
    return all_of([magic == "KFCE", version <= 1])


def picture_limits(width: Column, height: Column) -> Column:
    """Sides of 1 to 8192 and at most 36,864 blocks of 16."""
    blocks = F.ceil(width / 16) * F.ceil(height / 16)
    return all_of([width.between(1, 8192), height.between(1, 8192), blocks <= 36_864])
