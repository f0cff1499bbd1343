"""Operator 10, license scans in DataFrame expressions only.

Templates are cut into 5-word shingles.  Templates of similar length form a class; a document's words are cut into windows a
little longer than the class's templates, overlapping so that every passage of a template's length lies whole in some window.
Windows and templates get MinHash signatures; equal bands retrieve candidates, which are then verified by exact
containment: at least `percent` of the template's shingles stand in the window.

A window of w shingles that holds the least number m of a template's n that passes has similarity m / (w + n - m); each
class takes as many bands of one or two rows as keep the chance of missing such a window under `miss` for all its templates.

Before any window is made, documents without one of the templates' anchor words are set aside: a template's anchors are words
whose shingles are more than 100 - percent of all its shingles, so a window without them cannot reach the containment.

Cases: null and empty texts match nothing; repeated rows give repeated results; templates without words are ignored;
a template of fewer than 5 words is one shingle of all its words; templates that one window holds alike (ties) are all listed, by name;
long texts are cut into windows whole; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import table

# Notices of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
}
K = 5
#: A word: a run of ASCII letters, digits and all characters beyond ASCII, in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def shingles(w: Column) -> Column:
    """The distinct K-word shingles of an array of words; the whole of a shorter, non-empty array."""
    n = F.greatest(F.lit(1), F.size(w) - K + 1)
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, F.lit(K)), " "))))


@dataclass
class LengthClass:
    """Templates whose lengths share a power of sqrt(2), and their windows and bands."""

    names: list[str]
    longest: int
    stride: int
    rows: int = 1
    bands: int = field(default=8)

    @property
    def window(self) -> int:
        return self.longest + self.stride - 1


def _words_of(text: str) -> list[str]:
    import re

    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _n_shingles(text: str) -> int:
    w = _words_of(text)
    return len({tuple(w[i : i + K]) for i in range(max(1, len(w) - K + 1))})


def length_classes(templates: dict[str, str], miss: float, percent: int = 80) -> list[LengthClass]:
    groups: dict[int, list[str]] = {}
    for name, text in templates.items():
        if n := len(_words_of(text)):
            groups.setdefault(round(2 * math.log2(n)), []).append(name)
    out = []
    for names in groups.values():
        sizes = [len(_words_of(templates[n])) for n in names]
        c = LengthClass(names, max(sizes), max(1, min(sizes) // 8))
        w = max(1, c.window - K + 1)
        similarity = min(m / (w + n - m) for n in map(_n_shingles, (templates[x] for x in names)) for m in [max(1, -(-percent * n // 100))])
        c.rows = 2 if similarity > 0.7 else 1
        c.bands = max(1, math.ceil(math.log(miss) / math.log(1 - similarity**c.rows))) if similarity < 1 else 1
        out.append(c)
    return out


def anchors(templates: dict[str, str], percent: int) -> list[str]:
    """Words of which every template holds so many that windows without them miss too many of its shingles."""
    out: set[str] = set()
    for text in templates.values():
        w = _words_of(text)
        if not w:
            continue
        grams = [frozenset(w[i : i + K]) for i in range(max(1, len(w) - K + 1))]
        open_ = [g for g in grams if not g & out]
        while len(open_) * 100 >= percent * len(grams):
            # The longest word of those that cover most: long words are the rarest.
            best = max({x for g in open_ for x in g}, key=lambda x: (len(x) * sum(x in g for g in open_) ** 0.5, x))
            out.add(best)
            open_ = [g for g in open_ if best not in g]
    return sorted(out)


def min_hashes(grams: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array_min(F.transform(grams, lambda g: F.xxhash64(g, i))))


def band_array(grams: Column, c: LengthClass) -> Column:
    # One-element array: the signature is made once and then cut into bands.
    signature = F.array(min_hashes(grams, c.bands * c.rows))
    return F.transform(signature, lambda s: F.transform(F.sequence(F.lit(0), F.lit(c.bands - 1)), lambda b: F.xxhash64(b, F.slice(s, b * c.rows + 1, F.lit(c.rows)))))[0]


def _matcher(templates: Column, window: int):
    """A function from a window to its candidate templates, those with an equal band, with their exact containment."""

    def match(x: Column) -> Column:
        got = F.filter(templates, lambda t: F.exists(F.zip_with(t["bands"], x["bands"], lambda a, b: a == b), lambda same: same))
        return F.transform(got, lambda t: F.struct(t["name"].alias("name"), x["first"].alias("first"), F.lit(window).alias("words"), (F.size(F.array_intersect(t["grams"], x["grams"])) * 100.0 / F.size(t["grams"])).alias("percent")))

    return match


def notices(windows: str) -> Column:
    """Windows (name, first, words, percent), sorted, as notices: windows of one name of which each overlaps the next, with the highest percent."""
    at = lambda i: F.get(windows, i)
    new = lambda i: (i == 0) | (at(i)["name"] != at(i - 1)["name"]) | (at(i)["first"] >= at(i - 1)["first"] + at(i - 1)["words"])
    starts = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), new)

    def joined(starts: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            after = F.coalesce(F.get(starts, k + 1), F.size(windows))
            percent = F.array_max(F.transform(F.slice(windows, i + 1, after - i), lambda x: x["percent"]))
            return F.struct(at(i)["name"].alias("name"), at(i)["first"].alias("first"), (at(after - 1)["first"] + at(after - 1)["words"] - at(i)["first"]).alias("words"), percent.alias("percent"))

        return F.transform(starts, one)

    return F.when(F.size(windows) > 0, F.transform(F.array(starts), joined)[0]).otherwise(F.col(windows))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """(doc_id, n_windows, n_matches, licenses, best, spans): one row for every row of docs.

    n_windows: windows verified; n_matches: notices found; licenses: names, sorted; best: highest containment in percent; spans:
    (name, first word, words, percent) of every notice, sorted: overlapping windows of one template are one notice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    need = anchors(templates, percent)
    lower = F.lower(F.col("text"))
    near = F.lit(False)
    for a in need:
        near = near | lower.contains(a)
    w = F.when(F.coalesce(near, F.lit(False)), words(F.col("text"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", w.alias("w"))
    hits = F.array().cast("array<struct<name:string,first:int,words:int,percent:double>>")
    tried = F.lit(0).cast("long")
    for c in length_classes(templates, miss, percent):
        known = spark.createDataFrame([(n, templates[n]) for n in c.names], "name string, text string").select("name", shingles(words(F.col("text"))).alias("grams"))
        known = known.select("name", "grams", band_array(F.col("grams"), c).alias("bands")).collect()
        # The templates are few and given by the caller, so they stand in the expression.
        cands = F.array(*[F.struct(F.lit(r.name).alias("name"), F.array(*map(F.lit, r.grams)).alias("grams"), F.array(*map(F.lit, r.bands)).alias("bands")) for r in known])
        last = F.greatest(F.lit(0), F.size("w") - c.window + c.stride - 1)
        starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), last, F.lit(c.stride))).otherwise(F.array().cast("array<int>"))
        held = F.filter(starts, lambda i: F.arrays_overlap(F.slice("w", i + 1, F.lit(c.window)), F.array(*map(F.lit, need))))
        windows = F.transform(held, lambda i: F.struct(i.alias("first"), shingles(F.slice("w", i + 1, F.lit(c.window))).alias("grams")))
        signed = F.transform(windows, lambda x: F.struct(x["first"].alias("first"), x["grams"].alias("grams"), band_array(x["grams"], c).alias("bands")))

        found = F.flatten(F.transform(signed, _matcher(cands, c.window)))
        rows = rows.withColumn("_found", F.when(F.size("w") > 0, found).otherwise(hits))
        rows = rows.withColumn(f"_c{c.longest}", F.filter("_found", lambda m: m["percent"] >= percent)).withColumn(f"_n{c.longest}", F.size("_found").cast("long")).drop("_found")
    names = [x for x in rows.columns if x.startswith("_c")]
    spans = F.array_sort(F.concat(*names)) if names else hits
    n = sum((F.col(x) for x in rows.columns if x.startswith("_n")), tried)
    out = rows.select("doc_id", n.alias("n_windows"), spans.alias("windows")).select("doc_id", "n_windows", notices("windows").alias("spans"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["percent"])), F.lit(0.0))
    return out.select(F.col("doc_id").alias(id_col), "n_windows", F.size("spans").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["name"]))), ",").alias("licenses"), best.alias("best"), "spans")


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["name"], s["first"].cast("string"), F.bround(s["percent"], 1).cast("string"))), ",")
    return found.select("doc_id", "n_matches", "licenses", "best", text.alias("spans"))
