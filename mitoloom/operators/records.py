"""Changes to call records: fields by declared type, filters, genotypes, alternatives in use, fields by allele and genotype."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations_with_replacement
from math import comb
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mitoloom.sources.headers import VcfHeader

KINDS = {"Integer": "int", "Float": "double", "String": "string", "Character": "string"}


def typed(fields: Column, key: str, number: str, kind: str) -> Column:
    """A field of a map of texts by its declared Number and Type: a list unless Number is 1; Flags are whether the key is there."""
    if kind == "Flag":
        return F.map_contains_key(fields, F.lit(key))
    value = F.get(F.map_values(F.map_filter(fields, lambda k, _: k == key)), F.lit(0))
    if number == "1":
        return value.try_cast(KINDS[kind])
    return F.transform(F.split(value, ","), lambda x: x.try_cast(KINDS[kind]))


def with_filter(filters: Column, name: str) -> Column:
    """A FILTER text with one more name; PASS and a point give way to it."""
    plain = filters.isNull() | filters.isin("PASS", ".", "")
    has = F.array_contains(F.split(filters, ";"), name)
    return F.when(plain, F.lit(name)).when(has, filters).otherwise(F.concat_ws(";", filters, F.lit(name)))


def genotype_text(gt: Column) -> Column:
    """An unphased GT text from allele numbers; null ones are points, an empty list is a point."""
    return F.when(F.size(gt) > 0, F.array_join(F.transform(gt, lambda g: F.coalesce(g.cast("string"), F.lit("."))), "/")).otherwise(".")


def with_field(fields: Column, key: str, value: Column) -> Column:
    """A map of texts with one field set."""
    return F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))


def used_alternatives(records: DataFrame) -> DataFrame:
    """records (site, alts, sample, gt) with alternatives that no genotype names dropped, and genotypes renumbered.

    The alleles in use are one small set a site, found by a partial aggregate and joined back.
    """
    used = records.select("site", F.explode("gt").alias("g")).where("g > 0").groupBy("site").agg(F.array_sort(F.collect_set("g")).alias("__used"))
    joined = records.join(used, "site", "left").withColumn("__used", F.coalesce("__used", F.array().cast("array<int>")))
    renumbered = F.transform("gt", lambda g: F.when(g > 0, F.array_position(F.col("__used"), g).cast("int")).otherwise(g))
    return joined.withColumns({"alts": F.transform("__used", lambda g: F.get("alts", g - 1)), "gt": renumbered}).drop("__used")


def without_filter(filters: Column, name: str) -> Column:
    """A FILTER text without a name; PASS where none is left."""
    left = F.array_remove(F.split(filters, ";"), name)
    return F.when(filters.isNull(), F.lit(None)).when(F.size(left) > 0, F.array_join(left, ";")).otherwise("PASS")


def with_info(info: Column, key: str, value: Column | None) -> Column:
    """An INFO text with a key set where it stood, or at the end; without a value, a flag; a null value takes the key away."""
    entries = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda e: ~e.isin("", "."))
    name = lambda e: F.split_part(e, F.lit("="), F.lit(1))
    text = F.lit(key) if value is None else F.concat(F.lit(f"{key}="), value.cast("string"))
    there = F.exists(entries, lambda e: name(e) == key)
    kept = F.filter(F.transform(entries, lambda e: F.when(name(e) == key, text).otherwise(e)), lambda e: e.isNotNull())
    whole = F.when(there, kept).otherwise(F.filter(F.concat(entries, F.array(text)), lambda e: e.isNotNull()))
    return F.when(F.size(whole) > 0, F.array_join(whole, ";")).otherwise(".")


def format_field(form: Column, sample: Column, key: str) -> Column:
    """A sample's text of a FORMAT field; null where FORMAT or the sample ends before it."""
    return F.get(F.split(sample, ":"), F.array_position(F.split(form, ":"), key).cast("int") - 1)


def with_format(rows: DataFrame, key: str, values: Column) -> DataFrame:
    """rows (format, samples) with a field of every sample set from an array of texts, where it stood or at the end; null ones are points.

    Records without a FORMAT get one of that field alone.
    """
    keys = F.when(F.col("format").isNull() | (F.col("format") == "."), F.array().cast("array<string>")).otherwise(F.split("format", ":"))
    at = F.coalesce(F.array_position("__keys", key), F.lit(0)).cast("int")
    held = rows.withColumns({"__keys": keys, "__values": values})
    held = held.withColumns({"__at": at}).withColumn("__at", F.when(F.col("__at") > 0, F.col("__at")).otherwise(F.size("__keys") + 1))

    def put(sample: Column, i: Column) -> Column:
        fields = F.when(F.size("__keys") == 0, F.array().cast("array<string>")).otherwise(F.split(sample, ":"))
        padded = F.concat(fields, F.array_repeat(F.lit("."), F.greatest(F.col("__at") - F.size(fields), F.lit(0)).cast("int")))
        return F.array_join(F.transform(padded, lambda f, j: F.when(j == F.col("__at") - 1, F.coalesce(F.get("__values", i), F.lit("."))).otherwise(f)), ":")

    new = F.array_join(F.when(F.array_contains("__keys", key), F.col("__keys")).otherwise(F.concat("__keys", F.array(F.lit(key)))), ":")
    return held.withColumns({"samples": F.transform("samples", put), "format": new}).drop("__keys", "__values", "__at")


def genotype_count(alleles: int, ploidy: int) -> int:
    return comb(alleles + ploidy - 1, ploidy)


def genotype_place(genotype: Sequence[int]) -> int:
    """The place of a genotype among all of its ploidy, in the order of fields with one value a genotype."""
    return sum(comb(a + m, m + 1) for m, a in enumerate(sorted(genotype)))


@lru_cache(maxsize=4096)
def _sources(kept: tuple[int, ...], ploidy: int) -> tuple[tuple[int, ...], ...]:
    """For each genotype of the new alleles, the places of the old ones that become it; kept[i] is what old allele i becomes (-1: gone)."""
    new: dict[tuple[int, ...], list[int]] = {}
    for old in combinations_with_replacement([i for i, k in enumerate(kept) if k >= 0], ploidy):
        new.setdefault(tuple(sorted(kept[i] for i in old)), []).append(genotype_place(old))
    every = sorted(combinations_with_replacement(range(max(kept) + 1), ploidy), key=genotype_place)
    return tuple(tuple(sorted(new[g])) for g in every)


def _ploidy(alleles: int, values: int) -> int | None:
    """The ploidy of which there are so many genotypes."""
    return next((p for p in range(1, 65) if genotype_count(alleles, p) >= values), None) if values else None


def _summed(values: list[str], kind: str) -> str:
    """Counts and shares of alleles that become one; a point if all are missing."""
    known = [v for v in values if v != "."]
    if len(values) == 1 or not known:
        return values[0]
    return str(sum(map(int, known))) if kind == "Integer" else repr(sum(map(float, known)))


def _best(values: list[str], kind: str) -> str:
    """Of genotypes that become one, the likeliest: the least of whole (phred) numbers, the largest of logarithms."""
    known = [v for v in values if v != "."]
    if len(values) == 1 or not known:
        return values[0]
    return min(known, key=int) if kind == "Integer" else max(known, key=float)


def remapped_field(text: str, number: str, kind: str, kept: tuple[int, ...]) -> str:
    """A field's text after a change of alleles, by its declared Number: A has a value for each alternative, R one for each allele,
    G one for each genotype, of any ploidy. A field with another count of values than that stays as it is; so do other Numbers.
    """
    values = text.split(",")
    n = len(kept)
    if number in ("A", "R"):
        first = 1 if number == "A" else 0
        if len(values) != n - first:
            return text
        groups = [[values[i - first] for i in range(first, n) if kept[i] == k] for k in range(first, max(kept) + 1)]
        return ",".join(_summed(g, kind) if g else "." for g in groups) or "."
    if number == "G":
        ploidy = _ploidy(n, len(values))
        if ploidy is None or genotype_count(n, ploidy) != len(values):
            return text
        return ",".join(_best([values[i] for i in places], kind) if places else "." for places in _sources(kept, ploidy))
    return text


def _remapped_genotype(text: str, kept: tuple[int, ...]) -> str:
    return re.sub(r"\d+", lambda m: str(kept[int(m[0])]) if int(m[0]) < len(kept) and kept[int(m[0])] >= 0 else ".", text)


def _remapped_record(row: dict[str, Any], info: dict[str, tuple[str, str]], form: dict[str, tuple[str, str]], new: list[int]) -> dict[str, Any]:
    alts = [] if row["alt"] in (None, ".", "") else row["alt"].split(",")
    kept = (0, *new)
    if len(kept) != len(alts) + 1 or any(k < -1 for k in kept) or sorted({k for k in kept if k >= 0}) != list(range(max(kept) + 1)):
        raise ValueError(f"not a numbering of {len(alts)} alternatives: {new}")
    names = [next((alts[i - 1] for i in range(1, len(kept)) if kept[i] == k), None) for k in range(1, max(kept) + 1)]
    out = dict(row, alt=",".join(names) or ".")
    if row["info"] not in (None, "."):
        fields = []
        for entry in row["info"].split(";"):
            key, given, value = entry.partition("=")
            fields.append(f"{key}={remapped_field(value, *info[key], kept)}" if given and key in info else entry)
        out["info"] = ";".join(fields)
    if row["format"] is not None and row["samples"] is not None:
        keys = row["format"].split(":")
        out["samples"] = [
            ":".join(_remapped_genotype(v, kept) if k == "GT" else remapped_field(v, *form[k], kept) if k in form else v for k, v in zip(keys, s.split(":"), strict=False)) for s in row["samples"]
        ]
    return out


def remapped(rows: DataFrame, header: VcfHeader, new: str = "new") -> DataFrame:
    """Records (alt, info, format, samples) after a change of their alleles, without the column ``new``: for each alternative, in order,
    its new number (from 1; the same for several that become one; 0 to count it as the reference; -1 to drop it).

    Every INFO and FORMAT field follows by its declared Number: values of alleles that become one are summed (A, R), those of genotypes
    that become one give the likeliest (G). Genotypes keep their phase; a dropped allele is missing in them. The first of
    alternatives that become one gives its text. A null ``new`` leaves the record as it is; numbers that leave a gap, or of another
    count than the alternatives, raise.
    """
    info, form = header.fields("INFO"), header.fields("FORMAT")
    columns = [c for c in rows.columns if c != new]
    at = {c: rows.columns.index(c) for c in ("alt", "info", "format", "samples", new)}

    def change(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = {c: frame.iloc[:, i].tolist() for c, i in at.items()}
            for i, numbers in enumerate(held[new]):
                if numbers is not None:
                    row = {c: None if (v := held[c][i]) is None or isinstance(v, float) else v for c in ("alt", "info", "format", "samples")}
                    for c, v in _remapped_record(row, info, form, [int(k) for k in numbers]).items():
                        held[c][i] = v
            frame = frame.copy()
            for c in ("alt", "info", "format", "samples"):
                frame.isetitem(at[c], pd.Series(held[c], index=frame.index, dtype=object))
            yield frame.drop(columns=[new])

    return rows.mapInPandas(change, rows.select(*columns).schema)


def unused_dropped(rows: DataFrame, header: VcfHeader) -> DataFrame:
    """Records without the alternatives that no genotype names; see remapped."""
    place = F.array_position(F.split("format", ":"), "GT").cast("int")
    named = F.flatten(F.transform("samples", lambda s: F.transform(F.split(F.coalesce(F.get(F.split(s, ":"), place - 1), F.lit("")), r"[/|]"), lambda g: g.try_cast("int"))))
    used = F.coalesce(F.filter(F.array_sort(F.array_distinct(named)), lambda g: g > 0), F.array().cast("array<int>"))
    alts = F.when((F.col("alt") == ".") | F.col("alt").isNull(), F.array().cast("array<string>")).otherwise(F.split("alt", ","))
    number = F.transform(alts, lambda _, i: F.coalesce(F.nullif(F.array_position("__used", (i + 1).cast("int")).cast("int"), F.lit(0)), F.lit(-1)))
    numbered = rows.withColumn("__used", used).withColumn("__new", F.when(F.col("format").isNotNull(), number)).drop("__used")
    return remapped(numbered, header, "__new")
