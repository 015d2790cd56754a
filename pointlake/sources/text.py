"""Points as text: parse strings say what each field is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.schema import DEFAULT_SCALE, ScaleOffset

#: The letter of each field.
LETTERS = {
    "i": "intensity", "a": "scan_angle_rank", "r": "return_number", "n": "number_of_returns", "c": "classification",
    "u": "user_data", "p": "point_source_id", "e": "edge_of_flight_line", "d": "scan_direction_flag", "h": "withheld_flag",
    "k": "keypoint_flag", "g": "synthetic_flag", "o": "overlap_flag", "l": "scanner_channel", "R": "red", "G": "green",
    "B": "blue", "t": "gps_time", "X": "xi", "Y": "yi", "Z": "zi", "w": "wave_index",
}
SEPARATORS = {"comma": ",", "tab": "\t", "dot": ".", "colon": ":", "semicolon": ";", "scolon": ";", "hyphen": "-", "space": " "}


def _number(value: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), "\\.$", ""))


def to_text(points: DataFrame, parse: str = "xyz", separator: str = "space", scaling: ScaleOffset = DEFAULT_SCALE) -> DataFrame:
    """One `value` per point: write.text() stores it. m and M are the point's number from 0 and 1; digits are attributes."""

    def field(letter: str) -> Column:
        if letter in "xyz":
            return _number(scaling.real(letter))
        if letter in "mM":
            return (F.col("point_index") + int(letter == "M")).cast("string")
        if letter.isdigit():
            return _number(F.col(f"attr_{letter}"))
        if letter == "s":
            return F.lit("0")
        column = F.col("nir") if letter == "I" else F.col(LETTERS[letter])
        return _number(column) if letter == "t" else column.cast("string")

    fields = [F.coalesce(field(c), F.lit("0")) for c in parse]
    return points.select(F.concat_ws(SEPARATORS.get(separator, separator), *fields).alias("value"))


def from_text(lines: DataFrame, parse: str, skip: int = 0, scaling: ScaleOffset = DEFAULT_SCALE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Points from a DataFrame with `value` (and `line`, from 0, if skip is over 0). Blank, comma, tab and semicolon separate.

    E stands for echo encoding: 0 single, 1 first, 2 middle, 3 last. H and J are hexadecimal
    colour and intensity, s is skipped. Lines of too few or unreadable fields are left out.
    """
    words = F.split(F.trim(F.regexp_replace("value", "[,;\\t ]+", " ")), " ")
    rows = (lines.where(F.col("line") >= skip) if skip else lines).withColumn("__w", words).where(F.size("__w") >= len(parse))
    made: dict[str, Column] = {}
    needed = []
    for k, letter in enumerate(parse):
        word = F.get("__w", F.lit(k))
        number = F.expr(f"try_cast(get(__w, {k}) as double)")
        if letter in "xyz":
            made[f"{letter}i"] = scaling.raw(letter, number)
            needed.append(number.isNotNull())
        elif letter == "t":
            made["gps_time"] = number
        elif letter.isdigit():
            made[f"attr_{letter}"] = number
        elif letter == "E":
            echo = number.cast("int")
            made["number_of_returns"] = F.when(echo == 0, 1).when(echo == 1, 2).otherwise(3)
            made["return_number"] = F.when(echo <= 1, 1).when(echo == 2, 2).otherwise(3)
        elif letter == "H":
            made |= {c: F.conv(F.substring(word, 2 * i + 1, 2), 16, 10).cast("int") for i, c in enumerate(("red", "green", "blue"))}
        elif letter == "J":
            made["intensity"] = F.conv(word, 16, 10).cast("int")
        elif letter == "I":
            made["nir"] = number.cast("int")
        elif letter != "s":
            made[LETTERS[letter]] = number.cast("int")
    for c in needed:
        rows = rows.where(c)
    return rows.select(*keep, *[v.alias(c) for c, v in made.items()])


def read_text(spark: SparkSession, path: str, parse: str, scaling: ScaleOffset = DEFAULT_SCALE) -> DataFrame:
    """Points of text files, gzip ones as well, with source_file; large files are split by Spark."""
    lines = spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path"))
    return from_text(lines, parse, scaling=scaling, keep=("source_file",))


def read_pts(spark: SparkSession, path: str, scaling: ScaleOffset = DEFAULT_SCALE) -> DataFrame:
    """PTS: x y z and an intensity of -2048 ... 2047, moved to 0 ... 4095; the count line is left out."""
    read = from_text(spark.read.text(path), "xyzi", scaling=scaling)
    return read.withColumn("intensity", F.col("intensity") + 2048)


def with_file_source_id(points: DataFrame, start: int = 0) -> DataFrame:
    """point_source_id becomes the number of the file in the order of names; one row a file is ranked and broadcast if small."""
    from pyspark.sql import Window

    files = points.select(F.col("source_file").alias("__f")).distinct()
    ranked = files.withColumn("__id", (F.row_number().over(Window.orderBy("__f")) - 1 + start).cast("int"))
    return points.join(ranked, F.col("source_file") == F.col("__f")).withColumn("point_source_id", F.col("__id")).drop("__f", "__id")
