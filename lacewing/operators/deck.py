"""Deck lists: keyed aggregation with conflicts, composite order, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: The order of groups, and the columns of an export in the order in which they always appear.
GROUPS = ("STANDARD", "ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO")
COLUMNS = ("cid", "name", "rarity", "quantity", "unit_price", "total", "priced")


def aggregate(rows: DataFrame, keys: list[str], quantity: str, sequence: list[str], first_seen: list[str]) -> DataFrame:
    """Per key: the summed quantity, how many lines, and the attributes of the line that came first."""
    return rows.groupBy(*keys).agg(F.sum(quantity).cast("long").alias("quantity"), F.count("*").alias("lines"), F.min_by(F.struct(*first_seen), F.struct(*sequence)).alias("first")).select(*keys, "quantity", "lines", "first.*")


def conflicts(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows disagree in `values`; null agrees with null only."""
    seen = F.collect_set(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}))
    return rows.groupBy(*key).agg(F.size(seen).cast("long").alias("variants")).where("variants > 1")


def ordinal(value: Column, order: tuple[str, ...]) -> Column:
    """1 and up by place in the list; after all of them if absent."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("int")


def deck_order(rows: DataFrame, group: Column, level: Column, stat: Column, passcode: Column, cid: Column) -> DataFrame:
    """`rows` with `place`: by group, level and stat from high to low, then passcode with those that have none last, then cid.

    Rows are numbered within their group, level and stat, and how many stand before those comes from counts. No task
    sees all rows: counts are summed up within a group, and only the groups' totals, one row each, over all.
    """
    keyed = rows.withColumns({"k_group": group, "k_level": level, "k_stat": stat, "k_passcode": passcode, "k_cid": cid})
    steps = keyed.groupBy("k_group", "k_level", "k_stat").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = steps.select("k_group", "k_level", "k_stat", before(Window.partitionBy("k_group").orderBy(F.desc("k_level"), F.desc("k_stat"))).alias("inner"))
    groups = steps.groupBy("k_group").agg(F.sum("n").alias("n")).select("k_group", before(Window.orderBy("k_group")).alias("outer"))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    offsets = within.join(groups, same(within, groups, ["k_group"])).select(within["k_group"].alias("o_group"), F.col("k_level").alias("o_level"), F.col("k_stat").alias("o_stat"), (F.col("inner") + F.col("outer")).alias("offset"))
    own = Window.partitionBy("k_group", "k_level", "k_stat").orderBy(F.col("k_passcode").asc_nulls_last(), "k_cid")
    numbered = keyed.withColumn("own_place", F.row_number().over(own))
    on = F.col("k_group").eqNullSafe(F.col("o_group")) & F.col("k_level").eqNullSafe(F.col("o_level")) & F.col("k_stat").eqNullSafe(F.col("o_stat"))
    placed = numbered.join(offsets, on).withColumn("place", (F.col("offset") + F.col("own_place")).cast("long"))
    return placed.drop("o_group", "o_level", "o_stat", "offset", "own_place", "k_cid")


def sorted_deck(rows: DataFrame, cards: DataFrame, rarities: tuple[str, ...]) -> DataFrame:
    """Aggregated `rows` (cid, rarity, …) with `place`, from 1, in deck order: group, subtype, level, attack and defence from high to low, then
    passcode with cards that have none last, cid, and the rarity's place in `rarities`.

    `cards` is what `species_order` gives of the official texts, with cid and passcode, best stored. A card that it lacks or that couldn't
    be read, and a rarity that isn't listed, end the job with the card's id: no row is left out or put somewhere else.
    """
    placed = rows.join(cards.select("cid", *ORDER, "passcode", "problem", F.lit(True).alias("known")), "cid", "left")
    rank = F.array_position(F.array(*map(F.lit, rarities)), F.col("rarity"))
    fault = F.when(F.col("known").isNull(), "not in the catalogue").when(F.col("problem").isNotNull(), F.col("problem")).when(F.coalesce(rank, F.lit(0)) == 0, "rarity")
    fault = F.when(fault.isNotNull(), F.concat(F.lit("card "), F.col("cid").cast("string"), F.lit(": "), fault))
    whole = complete(placed.withColumn("problem", fault).withColumn("rarity_rank", rank))
    order = [F.col("group"), F.col("subtype"), F.desc("level"), F.desc("atk"), F.desc("def"), F.col("passcode").asc_nulls_last(), F.col("cid"), F.col("rarity_rank")]
    return numbered(whole, order, "deck").withColumn("place", F.col("rank") + 1).drop("rank", "known", "rarity_rank", "passcode", *ORDER)


ORDER = ("group", "subtype", "level", "atk", "def")


def selected(wanted: set[str], columns: tuple[str, ...] = COLUMNS) -> list[str]:
    """The wanted columns in canonical order, whatever order they were asked for in; an unknown name is an error."""
    if unknown := wanted - set(columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return [c for c in columns if c in wanted]


def priced_rows(rows: DataFrame, wanted: set[str]) -> DataFrame:
    """Export rows: total is unit price times quantity, and null as the price is where there is none."""
    full = rows.withColumn("total", F.col("unit_price") * F.col("quantity")).withColumn("priced", F.col("unit_price").isNotNull())
    return full.select(*selected(wanted))


#: The marks of a species line, the subtypes in their order, and the tokens that a species may have.
OPEN, CLOSE, BETWEEN = "【 ", " 】", "／"
MAIN, EXTRA = ("通常", "効果", "儀式"), ("融合", "シンクロ", "エクシーズ", "リンク")
SPELL, TRAP = ("", "儀式", "速攻", "永続", "装備", "フィールド"), ("", "永続", "カウンター")
TOKENS = (*MAIN, *EXTRA, "ペンデュラム", "チューナー", "スピリット", "ユニオン", "デュアル", "トゥーン", "リバース", "特殊召喚")
ATTRIBUTES = ("光属性", "闇属性", "地属性", "水属性", "炎属性", "風属性", "神属性")
LEVELS = {"リンク": "リンク", "エクシーズ": "ランク"}
ATTACK, DEFENCE = "攻撃力", "守備力"


def species_tokens(species: Column) -> Column:
    """The tokens after the race; null where the line isn't a race and one token or more, or a token is unknown or repeated."""
    inner = F.regexp_extract(species, f"^{OPEN}([^{BETWEEN}]+(?:{BETWEEN}[^{BETWEEN}]+)+){CLOSE}$", 1)
    tokens = F.slice(F.split(inner, BETWEEN), 2, 100)
    fine = (inner != "") & (F.size(F.array_except(tokens, F.array(*map(F.lit, TOKENS)))) == 0) & (F.size(F.array_distinct(tokens)) == F.size(tokens))
    return F.when(fine, tokens)


def labelled_number(text: Column, label: Column | str, form: str = "[0-9]+") -> Column:
    """What follows the label and a space, if that is all of the text."""
    head = F.concat(F.lit(label) if isinstance(label, str) else label, F.lit(" "))
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    return F.when(F.startswith(text, head) & rest.rlike(f"^(?:{form})$"), rest)


def species_order(cards: DataFrame) -> DataFrame:
    """`cards` with group (0 monster, 1 spell, 2 trap, 3 extra deck), subtype, level, atk and def from attribute, effect, species,
    level_rank, link_markers, atk_text and def_text; and `problem`, null where all of it could be read."""
    place = lambda value, order: F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)).cast("int") - 1
    has = lambda token: F.array_contains("tokens", token)
    form = lambda value: F.when(value == "?", -1).when(value == "-", 0).otherwise(value.try_cast("long")).cast("long")
    read = cards.withColumn("tokens", species_tokens(F.col("species"))).withColumn("extra", F.array_intersect(F.array(*map(F.lit, EXTRA)), "tokens"))
    kind = F.when(F.col("attribute") == "魔法", 1).when(F.col("attribute") == "罠", 2).when(~F.col("attribute").isin(*ATTRIBUTES), None).when(F.size("extra") == 1, 3).when(F.size("extra") == 0, 0)
    read = read.withColumns({"group": kind, "first": F.get("extra", F.lit(0)), "own": F.coalesce("effect", F.lit(""))})
    group, link = F.col("group"), F.coalesce(F.col("first") == "リンク", F.lit(False))
    main = F.when(has("儀式"), 2).when(has("通常") != has("効果"), F.when(has("通常"), 0).otherwise(1))
    subtype = F.when(group == 1, place(F.col("own"), SPELL)).when(group == 2, place(F.col("own"), TRAP)).when(group == 3, place(F.col("first"), EXTRA)).when(group == 0, main)
    ranked = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.col("first")), F.lit("レベル"))
    level = labelled_number(F.when(link, F.col("link_markers")).otherwise(F.col("level_rank")), ranked).try_cast("long")
    none_other = F.when(link, F.col("level_rank")).otherwise(F.col("link_markers")).isNull()
    defence = F.when(link, labelled_number(F.col("def_text"), DEFENCE, "-")).otherwise(labelled_number(F.col("def_text"), DEFENCE, r"[0-9]+|\?"))
    stats = {"level": F.when(none_other, level), "atk": form(labelled_number(F.col("atk_text"), ATTACK, r"[0-9]+|\?")), "def": form(defence)}
    read = read.withColumns({"subtype": subtype, **{n: F.when(group.isin(1, 2), F.lit(0).cast("long")).when(group.isNotNull(), c) for n, c in stats.items()}})
    problem = F.when(F.col("attribute").isNull(), "metadata").when(group.isNull(), "kind")
    for name in ("subtype", "level", "atk", "def"):
        problem = problem.when(F.col(name).isNull(), name)
    return read.withColumn("problem", problem.when(F.col("passcode") <= 0, "passcode")).drop("tokens", "extra", "first", "own")


def complete(rows: DataFrame, problem: str = "problem") -> DataFrame:
    """`rows` without `problem`; the first row that has one ends the job."""
    return rows.withColumn(problem, F.when(F.col(problem).isNotNull(), F.raise_error(F.col(problem)))).where(F.col(problem).isNull()).drop(problem)
