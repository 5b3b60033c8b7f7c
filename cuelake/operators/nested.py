"""Nested records into related flat tables, and the readable payloads of transcript files.

``flatten_nested`` follows a schema: scalars and nested structs of a level become columns, every array level becomes
a child table whose rows carry the surrogate key of their parent (``_parent``), their own (``_key``) and the ordinal
in the array (``_ord``, from 0). Keys are paths of ordinals below the root's key, so they are the same in every run
and need no numbering pass; each level is one ``posexplode`` without an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.session import materialise

#: Options of the JSON reader that make it as strict as the format: only double quotes; what breaks is kept aside.
_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
#: Number or text of one, after trimming.
NUMBER = r"^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.)([eE][+-]?\d+)?\s*$|^\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
_CORE = (
    "root array<struct<language:string,duration:string,model_size:string,text:string,diarization:string,segments:array<struct<start:string,end:string,text:string,speaker:string,"
    "words:array<struct<start:string,end:string,word:string>>>>>>, _broken string"
)


def merged_schema(df: DataFrame, payload: str) -> T.StructType:
    """One schema that holds all JSON objects of a column: fields are united, scalar types become strings."""
    spark = df.sparkSession
    texts = df.select(F.col(payload).alias("value")).where("value IS NOT NULL")
    jvm = spark._jvm
    reader = spark._jsparkSession.read().option("primitivesAsString", "true")
    schema = reader.json(getattr(texts._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING())).schema()
    return T.StructType.fromJson(__import__("json").loads(schema.json()))


def _scalars(schema: T.StructType, at: Column, prefix: str = "") -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += _scalars(f.dataType, at[f.name], f"{prefix}{f.name}_")
        elif not isinstance(f.dataType, T.ArrayType):
            out.append((prefix + f.name, at[f.name]))
    return out


def _arrays(schema: T.StructType, at: Column, prefix: str = "") -> list[tuple[str, Column, T.DataType]]:
    out: list[tuple[str, Column, T.DataType]] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += _arrays(f.dataType, at[f.name], f"{prefix}{f.name}_")
        elif isinstance(f.dataType, T.ArrayType):
            out.append((prefix + f.name, at[f.name], f.dataType.elementType))
    return out


def _columns(pairs: list[tuple[str, Column]], taken: set[str]) -> list[Column]:
    out = []
    for name, column in pairs:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(column.alias(name))
    return out


def flatten_nested(df: DataFrame, key: str, record: str, root: str = "root") -> dict[str, DataFrame]:
    """Flat tables of the struct (or array) column ``record``, by path: ``root``, ``root_segments``, ...

    Every table has ``key`` (the root's key, as it is), ``_key``, ``_parent`` (null at the root) and ``_ord``. A null
    or empty array has no rows in the child table, a null element is a row of nulls, an empty table gives empty
    tables. A field whose name is taken gets underscores appended; other columns of ``df`` are left out.
    """
    tables: dict[str, DataFrame] = {}

    def level(name: str, at: DataFrame, kind: T.DataType) -> None:
        """``at`` has key, _key, _parent, _ord and the level's value as _value."""
        taken = {key.lower(), key, "_key", "_parent", "_ord", "_value"}
        fixed = [F.col(key), F.col("_key"), F.col("_parent"), F.col("_ord")]
        if isinstance(kind, T.StructType):
            tables[name] = at.select(*fixed, *_columns(_scalars(kind, F.col("_value")), taken))
            below = _arrays(kind, F.col("_value"))
        elif isinstance(kind, T.ArrayType):
            tables[name] = at.select(*fixed)
            below = [("items", F.col("_value"), kind.elementType)]
        else:
            tables[name] = at.select(*fixed, F.col("_value").alias("value"))
            below = []
        for child, column, inner in below:
            rows = at.select(F.col(key), F.col("_key").alias("_parent"), F.posexplode(column).alias("_ord", "_value"))
            rows = rows.select(key, F.concat_ws("/", "_parent", F.lit(child), F.col("_ord").cast("string")).alias("_key"), "_parent", "_ord", "_value")
            level(f"{name}_{child}", rows, inner)

    kind = df.schema[record].dataType
    base = df.select(F.col(key), F.col(key).cast("string").alias("_key"), F.lit(None).cast("string").alias("_parent"), F.lit(0).alias("_ord"), F.col(record).alias("_value"))
    level(root, base, kind)
    return tables


def _wrapped(payload: Column) -> Column:
    """The payload without a byte-order mark as the only element of a list: what follows the object breaks it."""
    return F.concat(F.lit('{"root":['), F.regexp_replace(payload, "^\\x{FEFF}", ""), F.lit("]}"))


def readable_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows of ``df`` whose payload is a transcript: an object with a list of segment objects, every segment and
    word with a start and an end that are numbers or texts of one. Null, empty, broken and foreign payloads drop out."""
    parsed = F.from_json(_wrapped(F.col(payload)), _CORE, _JSON)
    timed = lambda x: F.coalesce(x["start"].rlike(NUMBER) & x["end"].rlike(NUMBER), F.lit(False))
    good = F.forall("_p.segments", lambda s: s.isNotNull() & timed(s) & F.forall(F.coalesce(s["words"], F.array()), lambda w: w.isNotNull() & timed(w)))
    return (
        df.withColumn("_parsed", parsed)
        .where("_parsed._broken IS NULL AND size(_parsed.root) = 1 AND get(_parsed.root, 0).segments IS NOT NULL")
        .withColumn("_p", F.get("_parsed.root", F.lit(0)))
        .where(good)
        .drop("_parsed", "_p")
    )


def payload_tables(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> dict[str, DataFrame]:
    """Flat tables of all readable payloads under their merged schema: ``transcript``, ``transcript_segments``,
    ``transcript_segments_words`` and one table for each further array level."""
    # Each payload is checked once and parsed once; the schema and all tables come from what was written.
    good = materialise(readable_payloads(df.select(key, payload), payload))
    schema = merged_schema(good.withColumn(payload, F.regexp_replace(payload, "^\\x{FEFF}", "")), payload)
    if "segments" not in schema.fieldNames() or not isinstance(schema["segments"].dataType, T.ArrayType) or not isinstance(schema["segments"].dataType.elementType, T.StructType):
        schema = T.StructType.fromDDL("language string, segments array<struct<start:string,end:string,text:string,speaker:string,words:array<struct<start:string,end:string,word:string>>>>")
    schema = _with_words(schema)
    record = F.from_json(F.regexp_replace(F.col(payload), "^\\x{FEFF}", ""), schema, _JSON)
    return flatten_nested(materialise(good.select(key, record.alias("_record"))), key, "_record", "transcript")


def _with_words(schema: T.StructType) -> T.StructType:
    """The merged schema with a word level even where no payload has words."""
    word = T.StructType.fromDDL("start string, end string, word string")
    fields = []
    for f in schema.fields:
        if f.name == "segments":
            inner = [g for g in f.dataType.elementType.fields if g.name != "words"]
            old = next((g.dataType for g in f.dataType.elementType.fields if g.name == "words"), None)
            keep = old if isinstance(old, T.ArrayType) and isinstance(old.elementType, T.StructType) else T.ArrayType(word)
            f = T.StructField("segments", T.ArrayType(T.StructType([*inner, T.StructField("words", keep)])))
        fields.append(f)
    return T.StructType(fields)
