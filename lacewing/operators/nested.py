"""Closed nested records: every unknown, missing and ill-typed key of JSON documents, at any depth, in one pass."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Spark's own JSON reader takes, too: letters of a number, and objects and arrays within each other.
_DIGITS = _LEVELS = 1000
_LONG = range(-(1 << 63), 1 << 63)
#: What a scalar of a kind is; a whole number may be of any size where it stands for a double.
KINDS: dict[str, Callable[[object], bool]] = {
    "bigint": lambda v: v.__class__ is int and v in _LONG, "string": lambda v: v.__class__ is str, "boolean": lambda v: v.__class__ is bool, "double": lambda v: v.__class__ in (int, float),
}


class Shape:
    """A closed shape, from nested Python values: a dict is an object with just these keys, {"*": x} a map of any keys to x, [x] an array
    of x, and a name a scalar; with a question mark it may be null, but not absent."""

    def __init__(self, form: object):
        self.faults = _judge(form)


def _judge(form: object) -> Callable[[object, str], Iterator[tuple[str, str]]]:
    """The faults of a value, each with its path; what stands under a fault isn't looked at."""
    if isinstance(form, list):
        part = _judge(form[0])

        def array(value: object, path: str) -> Iterator[tuple[str, str]]:
            if value.__class__ is not list:
                yield path, "type"
            else:
                for i, v in enumerate(value):
                    yield from part(v, f"{path}.{i}")

        return array
    if not isinstance(form, dict):
        kind = KINDS.get(str(form).removesuffix("?"))
        if kind is None:
            raise ValueError(f"no such kind: {form}")
        return _scalar(kind, str(form).endswith("?"))
    every = form["*"] if list(form) == ["*"] else None
    parts = {} if every is not None else {k: _judge(x) for k, x in form.items()}
    part = _judge(every) if every is not None else None
    # most keys are of scalars, which are judged without a call of their own
    simple = {k: (KINDS[str(x).removesuffix("?")], str(x).endswith("?")) for k, x in form.items() if every is None and not isinstance(x, (list, dict))}

    def fields(value: object, path: str) -> Iterator[tuple[str, str]]:
        if value.__class__ is not dict:
            yield path, "type"
        elif part is not None:
            for k, v in value.items():
                yield from part(v, f"{path}.{k}")
        else:
            for k, v in value.items():
                if k in simple:
                    fits, empty = simple[k]
                    if not (fits(v) or (empty and v is None)):
                        yield f"{path}.{k}", "type"
                elif k in parts:
                    yield from parts[k](v, f"{path}.{k}")
                else:
                    yield f"{path}.{k}", "unknown"
            if not parts.keys() <= value.keys():
                yield from ((f"{path}.{k}", "missing") for k in parts if k not in value)

    return fields


def _scalar(fits: Callable[[object], bool], empty: bool) -> Callable[[object, str], Iterator[tuple[str, str]]]:
    def scalar(value: object, path: str) -> Iterator[tuple[str, str]]:
        if not (fits(value) or (empty and value is None)):
            yield path, "type"

    return scalar


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """An object; one that names a key twice is no JSON."""
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _number(read: Callable[[str], object]) -> Callable[[str], object]:
    def number(text: str) -> object:
        if len(text) > _DIGITS:
            raise ValueError("long number")
        return read(text)

    return number


def _constant(text: str) -> object:
    raise ValueError(text)


def _deep(value: object) -> bool:
    level = [value]
    for _ in range(_LEVELS):
        level = [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
    return any(isinstance(x, (dict, list)) for x in level)


def _parsed(decoder: json.JSONDecoder, doc: str) -> object:
    """The first value of a text; what follows it isn't looked at, unless it touches a number or a word."""
    doc = doc.lstrip(" \t\n\r")
    value, end = decoder.raw_decode(doc)
    if (not isinstance(value, (dict, list, str)) and doc[end : end + 1].strip(" \t\n\r")) or (doc.count("{") + doc.count("[") > _LEVELS and _deep(value)):
        raise ValueError("no value by itself")
    return value


_FOUND = "array<struct<path:string,fault:string>>"


def faults(rows: DataFrame, key: list[str], text: str, shape: Shape) -> DataFrame:
    """(key, path, fault): `not JSON`, and each `unknown`, `missing` and ill-typed (`type`) key of the JSON in `text`, by its path.

    Documents are read batch by batch, one at a time, and only their faults become rows; nothing is shuffled. What stands under an
    unknown or ill-typed key isn't looked at. A null text is not JSON.
    """
    found = F.arrow_udf(_reader(shape), _FOUND)(text)
    return rows.select(*key, found.alias("found")).select(*key, F.explode_outer("found").alias("at")).where("at is not null").select(*key, "at.path", "at.fault")


def _reader(shape: Shape) -> Callable[[pa.Array], pa.Array]:
    def read(docs: pa.Array) -> pa.Array:
        decoder = json.JSONDecoder(object_pairs_hook=_once, parse_int=_number(int), parse_float=_number(float), parse_constant=_constant)
        offsets, paths, said = [0], [], []
        for doc in map(pa.StringScalar.as_py, docs):
            try:
                found = list(shape.faults(_parsed(decoder, doc), "$")) if doc is not None else [("$", "not JSON")]
            except (ValueError, RecursionError):
                found = [("$", "not JSON")]
            for path, fault in found:
                paths.append(path.encode("utf-8", "replace").decode())
                said.append(fault)
            offsets.append(len(paths))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(said, pa.string())], names=["path", "fault"]))

    return read


NAMES = ("name_ja", "name_en", "name_ko")
#: The shape of a reference index and of a name cache, and how an image is called.
ARTWORK = {"ciid": "bigint", "image": "string", "sha256": "string"}
INDEX = Shape({"schema": "bigint", "cards": {"*": {"cid": "bigint", **{n: "string?" for n in NAMES}, "source_url": "string", "artworks": [ARTWORK]}}})
CACHE = Shape({"*": {"cid": "bigint", "name_ko": "string?", "name_ja": "string?", "name_en": "string", "source_url": "string", "image_path": "string"}})
SCHEMA = 1
IMAGE = ("images/%s_%s_%s.png", "images/%s_%s_%s.jpg")


def index_cards(rows: DataFrame, key: list[str], text: str, address: Column) -> DataFrame:
    """(key, card, cid, names, artworks, problem) of each card of index documents whose shape is right: the first rule that a card breaks.

    The cid is the card's key, some name isn't null and none is blank, the address is `address` (in terms of cid), there are artworks, each
    of a ciid of its own, and an image's name has the card, the artwork and the digest in it.
    """
    form = f"struct<schema:bigint,cards:map<string,struct<cid:bigint,{','.join(f'{n}:string' for n in NAMES)},source_url:string,artworks:array<struct<ciid:bigint,image:string,sha256:string>>>>>"
    read = rows.select(*key, F.from_json(text, form).alias("i"))
    cards = read.select(*key, F.col("i.schema").alias("schema"), F.explode("i.cards").alias("card", "c")).select(*key, "schema", "card", "c.*")
    named = F.array(*NAMES)
    ids = F.transform("artworks", lambda a: a["ciid"])
    image = lambda a: F.coalesce(a["image"].isin(*[F.format_string(form, F.col("card"), a["ciid"].cast("string"), F.substring(a["sha256"], 1, 12)) for form in IMAGE]), F.lit(False))
    problem = (
        F.when(F.coalesce(F.col("schema") != SCHEMA, F.lit(True)), "schema").when(F.coalesce((F.col("cid") <= 0) | (F.col("cid").cast("string") != F.col("card")), F.lit(True)), "cid")
        .when(F.exists(named, lambda n: F.coalesce(F.trim(n) == "", F.lit(False))) | F.forall(named, lambda n: n.isNull()), "name").when(F.coalesce(F.col("source_url") != address, F.lit(True)), "address")
        .when(F.coalesce(F.size("artworks"), F.lit(0)) < 1, "no artworks").when((F.size(F.array_distinct(ids)) < F.size(ids)) | F.exists(ids, lambda x: F.coalesce(x <= 0, F.lit(True))), "artwork").when(~F.forall("artworks", image), "image")
        .when(~F.forall("artworks", lambda a: a["sha256"].rlike("^[0-9a-f]{64}$")), "sha256")
    )
    return cards.select(*key, "card", "cid", *NAMES, "artworks", problem.alias("problem"))


def cached_cards(rows: DataFrame, key: list[str], text: str, name_key: Column, address: Column) -> DataFrame:
    """(key, card, cid, image_path, problem) of each entry of name cache documents whose shape is right: `name_key` and `address`, in terms of
    the entry's fields, must be its key and its address."""
    form = "map<string,struct<cid:bigint,name_ko:string,name_ja:string,name_en:string,source_url:string,image_path:string>>"
    cards = rows.select(*key, F.explode(F.from_json(text, form)).alias("card", "c")).select(*key, "card", "c.*")
    problem = F.when(F.coalesce(F.col("cid") <= 0, F.lit(True)), "cid").when(F.coalesce(name_key != F.col("card"), F.lit(True)), "name").when(F.coalesce(F.col("source_url") != address, F.lit(True)), "address").when(F.col("image_path").isNull(), "image")
    return cards.select(*key, "card", "cid", "image_path", problem.alias("problem"))
