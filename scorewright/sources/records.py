"""Tolerant readers of JSON and JSON Lines, and their defaults."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import json as J
from scorewright.functions import text as T

# The keys of a text, in the order they are tried.
TEXT_KEYS = ("text", "input", "prompt", "question", "original")
# The messages of the record that stands for a file without any.
DEFAULT_RECORD = (
    ("user", "请根据病历生成一道医学选择题。"),
    ("assistant", "冠状动脉粥样硬化要紧侵犯以下分支( )\nA. 回旋支、左室支\nB. 前距离支、边缘支\nC. 前降支、左旋支\nD. 房室结支、心室支\n\n**答案：C**"),
)
#: A file of no more bytes may be salvaged as one object, in one task.
WHOLE_BYTES = 64 << 20


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _required(spark: SparkSession, path: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, line) with the place of each line in its file; files of a folder follow each other by name.

    Nothing is shuffled: lines are numbered where they are read, and the driver has one count for each split of a file.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"))
    placed = read.withColumn("_at", F.monotonically_increasing_id())
    splits = sorted(placed.groupBy("_file", "_from").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect())
    before, seen = [], 0
    for r in splits:
        before.append((r["_file"], r["_from"], seen - r["first"]))
        seen += r["n"]
    shift = F.broadcast(spark.createDataFrame(before, "_file string, _from long, _shift long"))
    return placed.join(shift, ["_file", "_from"]).select((F.col("_at") + F.col("_shift")).alias("idx"), F.col("value").alias("line"))


def first_text(parsed: DataFrame) -> DataFrame:
    """`text` of rows (line, p): the first non-blank string among TEXT_KEYS of an object, else none; the stripped line where the
    rules fail: no JSON, a number, boolean or null, a list or string that holds one of the keys."""
    canon = F.col("p.canon")
    fields = [J.field(canon, k) for k in TEXT_KEYS]
    of_object = F.coalesce(*[F.when(f["is_string"], T.non_blank(f["text"])) for f in fields])
    raw = T.strip(F.col("line"))
    items = F.from_json(F.when(F.col("p.kind") == "array", canon), "array<string>")
    held = F.when(F.col("p.kind") == "array", F.coalesce(F.arrays_overlap(items, F.array(*map(F.lit, TEXT_KEYS))), F.lit(False)))
    text_value = F.try_variant_get(F.try_parse_json(canon), "$", "string")
    in_string = F.lit(False)
    for k in TEXT_KEYS:
        in_string = in_string | text_value.contains(k)
    fails = ~F.col("p.ok") | F.col("p.kind").isin("number", "boolean", "null") | ((F.col("p.kind") == "array") & held) | ((F.col("p.kind") == "string") & in_string)
    return parsed.withColumn("text", F.when(fails, raw).when(F.col("p.kind") == "object", of_object))


def texts_of(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(idx, text) of rows (idx, line), blank lines and rows without a text left out, the first `most` of the rest."""
    out = first_text(rows.where(T.strip(F.col("line")) != "").withColumn("p", J.parse(T.strip(F.col("line"))))).where("text is not null")
    out = out.select("idx", "text")
    return out if most is None else out.orderBy("idx").limit(max(most, 0))


def jsonl_texts(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """texts_of a file; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "idx long, text string")
    return texts_of(lines(spark, path), most)


def salvaged(rows: DataFrame) -> DataFrame:
    """(idx, record, how) of rows (idx, line): the line's JSON, else that within its outermost braces, else without its code fence, else
    (line 0 only) the first braces of all lines joined by spaces. Lines that give nothing are left out."""
    stripped = rows.withColumn("line", T.strip(F.col("line")))
    tried = stripped.where("line <> ''").select(
        "idx", "line", J.parse(F.col("line")).alias("plain"), J.parse(J.braces(F.col("line"))).alias("braced"), J.parse(J.unfenced(F.col("line"))).alias("bare")
    )
    picked = tried.select(
        "idx",
        F.when(F.col("plain.ok"), F.col("plain.canon")).when(F.col("braced.ok"), F.col("braced.canon")).when(F.col("bare.ok"), F.col("bare.canon")).alias("record"),
        F.when(F.col("plain.ok"), "line").when(F.col("braced.ok"), "braces").when(F.col("bare.ok"), "fence").alias("how"),
    )
    # the whole file is looked at only where line 0 has something and gave nothing, as small files with one spread-out object do
    if not picked.where("idx = 0 and record is null").isEmpty():
        size = rows.agg(F.sum(F.octet_length("line") + 2)).first()[0]
        if size > WHOLE_BYTES:
            raise ValueError(f"line 0 is no record, and {size} bytes are too many for one object (at most {WHOLE_BYTES})")
        whole = rows.agg(F.concat_ws("\n ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda r: r["line"])).alias("all"))
        found = whole.select(J.parse(J.shallow_braces(F.col("all"))).alias("p")).where("p.ok")
        picked = picked.where("record is not null").unionByName(found.select(F.lit(0).cast("long").alias("idx"), F.col("p.canon").alias("record"), F.lit("file").alias("how")))
    return picked.where("record is not null")


def default_record(spark: SparkSession) -> DataFrame:
    """(idx, record, how) of the one row that stands for a file without any record."""
    messages = {"messages": [{"role": role, "content": content} for role, content in DEFAULT_RECORD]}
    return spark.createDataFrame([(0, json.dumps(messages, ensure_ascii=False), "default")], "idx long, record string, how string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """salvaged lines of a file that must exist; the default record if there are none."""
    _required(spark, path)
    found = salvaged(lines(spark, path))
    return default_record(spark) if found.isEmpty() else found


def prompt_answer(rows: DataFrame) -> DataFrame:
    """(idx, prompt, answer) of rows (idx, record): prompt, else text, else ""; answer, else response, else "". A key that is there with null keeps
    its null. A record that is no object fails the query that reads it."""
    kind = F.schema_of_variant(F.parse_json("record"))
    wrong = F.raise_error(F.concat(F.lit("no object in row "), F.col("idx").cast("string")))
    record = F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.col("record")).otherwise(wrong.cast("string"))

    def chain(first, second):
        a, b = J.field(record, first), J.field(record, second)
        has = lambda f: F.coalesce(f["present"], F.lit(False))
        return F.when(has(a), a["text"]).when(has(b), b["text"]).otherwise("")

    return rows.select("idx", chain("prompt", "text").alias("prompt"), chain("answer", "response").alias("answer"))


def _array(spark: SparkSession, path: str, objects_too: bool) -> DataFrame:
    """(idx, record) of the items of a JSON file, or of all files of a folder by name; every root is looked at."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), J.parse(F.col("value")).alias("p"))
    canon = F.col("p.canon")
    items = F.from_json(F.when(F.col("p.kind") == "object", F.concat(F.lit("["), canon, F.lit("]"))).otherwise(canon), "array<string>")
    right = F.col("p.ok") & F.col("p.kind").isin("array", *["object"] * objects_too)
    roots = sorted(whole.select("_file", F.coalesce(right, F.lit(False)).alias("right"), F.when(right, F.size(items)).alias("n")).collect())
    if not roots or not all(r.right for r in roots):
        raise ValueError(f"{path}: the root is not an array")
    before, seen = [], 0
    for r in roots:
        before.append((r["_file"], seen))
        seen += r.n
    each = whole.join(F.broadcast(spark.createDataFrame(before, "_file string, _before long")), "_file").select("_before", F.posexplode(items).alias("pos", "record"))
    return each.select((F.col("_before") + F.col("pos")).alias("idx"), F.coalesce(J.parse(F.col("record"))["canon"], "record").alias("record"))


def dataset(spark: SparkSession, path: str, most: int = -1) -> DataFrame:
    """(idx, prompt, answer) of a .jsonl file (line indexes below `most`, bad and blank lines counted but left out) or a .json file (an array, capped
    alike, or one object). No positive `most` takes all; another suffix is a ValueError. A record that is no object fails the query."""
    _required(spark, path)
    if path.endswith(".jsonl"):
        rows = lines(spark, path)
        rows = rows.where(F.col("idx") < most) if most > 0 else rows
        rows = rows.withColumn("p", J.parse(F.col("line"))).where("p.ok").select("idx", F.col("p.canon").alias("record"))
    elif path.endswith(".json"):
        rows = _array(spark, path, objects_too=True)
        rows = rows.where(F.col("idx") < most) if most > 0 else rows
    else:
        raise ValueError(f"unsupported file type: {path}")
    return prompt_answer(rows)


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(idx, record) of the array in a file that must exist; any other root is a ValueError."""
    _required(spark, path)
    return _array(spark, path, objects_too=False)


def in_memory(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows at hand, by a schema."""
    return spark.createDataFrame(rows, schema)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The JSON Lines files of a folder as one table, its schema read from them."""
    return spark.read.json(path)
