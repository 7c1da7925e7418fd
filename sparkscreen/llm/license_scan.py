"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

Everything is DataFrame and SQL functions.  A file's statement is that line of its
whole text which is most alike to a template, by the cosine of their sparse TF-IDF
vectors; a licence file is also compared as a whole, and then with standard headers
and the bodies of licences too.  Document frequencies of all
terms are counted over all files.
A line can reach ``LIKE`` only if it holds one of a template's heaviest terms: those
without which what is left of the template is too short.  Of such lines those are
compared that would be alike if their other terms had the least weight, which loses none.

A file without a statement takes that of the nearest directory above it that has a
licence file.  Directories are resolved once each, by joining their ancestors with
the directories that declare a licence; files then join their directory.

Defined results: null and empty texts have no statement; files with a null path have
no directory and inherit nothing; of several licence files in a directory the most
alike counts, then the first template; a mere copyright phrase counts only where no licence is
stated, and not in a licence file that reads like a licence without being one of the known ones; equal templates' scores go to the first;
repeated rows stay; other columns are handed through, whatever they are called, but for
those named as a column of the result, which the result's own replace.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import let
from .license_bodies import BODIES, HEADERS
from .shared import Scratch

#: Least cosine of a statement.
LIKE = 0.6
#: Least cosine of a whole licence file with a body or a header of a licence that has versions: those are alike, and so are others of their kind.
WHOLE_LIKE = 0.88
#: The same for other licences.
BODY_LIKE = 0.7
#: The template that states no licence.
COPYRIGHT = "Proprietary"
#: What a text must say to be of that version, in terms joined by spaces; the texts of versions differ in little else.
VERSIONS = {
    "Apache-2.0": r"\b2 0\b", "MPL-2.0": r"\b2 0\b", "GPL-3.0": r"\b(?:version |v|gpl |gplv)3\b", "GPL-2.0": r"\b(?:version |v|gpl |gplv)2\b(?! 1\b)", "LGPL-3.0": r"\b(?:version |v|lgpl |lgplv)3\b", "LGPL-2.1": r"\b2 1\b",
    "AGPL-3.0": r"\b(?:version |v|agpl |agplv)3\b", "CC0-1.0": r"\bcc0\b",
}
#: Base names, in lower case and without what follows a dot, dash or underscore, of files that speak for their directory.
LICENCE_NAMES = ("license", "licence", "copying", "copyright", "notice", "unlicense")
#: Templates: name and statement, in order of preference.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-clause license"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Proprietary", "All rights reserved"),
)
RESULT = ("licence", "basis", "own_score", "from_directory")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_terms(templates=TEMPLATES) -> list[tuple[str, dict[str, int]]]:
    """Term counts of each template."""
    out = []
    for name, text in templates:
        counts: dict[str, int] = {}
        for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split():
            counts[w] = counts.get(w, 0) + 1
        out.append((name, counts))
    return out


#: Names and term counts of what licence files are compared with as a whole, beside the templates.
WHOLE = (*template_terms(HEADERS), *BODIES)


def terms_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")


def whole_terms(terms: list[str]) -> str:
    """A pattern for these terms where they stand alone, in either case."""
    return "(?i)(?<![a-z0-9])(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")(?![a-z0-9])"


def document_frequencies(files: DataFrame) -> DataFrame:
    """(term, df): files that hold each term of any text, counted within tasks before they are shuffled."""
    own = F.array_distinct(F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), "[^a-z0-9]+"))
    return files.select(F.explode(own).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def weight(n, df, log=math.log):
    """ln((1 + n) / (1 + df)) + 1."""
    return log((1 + n) / (1 + df)) + 1


def heavy_terms(templates, idf: dict[str, float], like: float = LIKE) -> list[str]:
    """Terms of which any text as like as that to some template has one."""
    out: dict[str, None] = {}
    for _, counts in templates:
        w = sorted(((c * idf[t], t) for t, c in counts.items()), key=lambda x: (-x[0], x[1]))
        left = whole = sum(x * x for x, _ in w)
        for x, t in w:
            if left < like * like * whole:
                break
            out[t] = None
            left -= x * x
    return list(out)


def can_be_like(words: Column, templates, idf: dict[str, float], like: float) -> Column:
    """Whether some template's cosine reaches ``like`` if each term outside the templates has the least weight there is, 1.

    Terms are counted once: those of the templates by name, and the squared length
    over the sorted terms, where each repetition of a term adds its share.
    """
    vocabulary = list(idf)
    at = {t: k for k, t in enumerate(vocabulary)}
    known = F.create_map(*[x for t, v in idf.items() for x in (F.lit(t), F.lit(v * v))])

    def step(a: Column, w: Column) -> Column:
        run = F.when(a["last"] == w, a["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), (a["sum"] + (2 * run - 1) * F.coalesce(F.try_element_at(known, w), F.lit(1.0))).alias("sum"))

    square = F.aggregate(F.array_sort(words), F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])
    tf = F.transform(F.array(*map(F.lit, vocabulary)), lambda t: F.size(F.filter(words, lambda w: w == t)))

    def any_fits(x: Column) -> Column:
        fits = []
        for _, counts in templates:
            norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))
            dot = sum((F.get(x["tf"], F.lit(at[t])) * (c * idf[t] * idf[t]) for t, c in counts.items()), F.lit(0.0))
            # A little less, so that rounding loses nothing.
            fits.append(dot >= (like - 1e-6) * norm * F.sqrt(x["square"]))
        return (x["square"] > 0) & reduce(or_, fits)

    return let(F.struct(tf.alias("tf"), square.alias("square")), any_fits)


def best_templates(units: DataFrame, frequencies: DataFrame, n: int, templates, idf: dict[str, float], for_lines: int, like: float, scratch: Scratch) -> DataFrame:
    """units: (_row, unit, whole, words).
    (_row, best): struct<licence, score, place> of the best cosine over the row's units and the templates, the first of equals.

    Every term, of a template or not, has its own weight, which is joined to it.
    Units that aren't whole files are compared with the first ``for_lines`` templates only.
    """
    names = F.array(*[F.lit(name) for name, _ in templates])
    by_term: dict[str, list] = {}
    for k, (_, counts) in enumerate(templates):
        for t, c in counts.items():
            by_term.setdefault(t, []).append({"place": k, "share": c * idf[t]})
    rows = [{"term": t, "shares": s} for t, s in by_term.items()]
    kind = "array<struct<place:int,share:double>>"
    shares = scratch.stage(units.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<term:string,shares:{kind}>>"))), "shares")
    key = ["_row", "unit", "whole"]
    counted = units.select(*key, F.explode("words").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("c"))
    weighed = counted.join(frequencies, "term").join(F.broadcast(shares), "term", "left").withColumn("w", F.col("c") * weight(n, F.col("df"), F.log))
    # At place -1 is the term itself, for the unit's squared length.
    own = F.array(F.struct(F.lit(-1).alias("place"), F.col("w").alias("share")))
    parts = weighed.select(*key, "w", F.inline(F.concat(own, F.coalesce("shares", F.array().cast(kind))))).where(F.col("whole") | (F.col("place") < for_lines))
    dots = parts.groupBy(*key, "place").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    each = dots.groupBy(*key).agg(F.sum(F.when(F.col("place") < 0, F.col("dot"))).alias("square"), F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "dot"))).alias("dots"))
    norms = F.array(*[F.lit(math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))) for _, counts in templates])
    # Rounded, so that the order of a sum decides nothing.
    scores = F.transform("dots", lambda d: F.struct((F.get(names, d["place"]) != COPYRIGHT).alias("licence"), F.round(d["dot"] / (F.sqrt("square") * F.get(norms, d["place"])), 9).alias("score"), (-d["place"]).alias("place")))
    body = lambda x: F.col("whole") & (-x["place"] >= for_lines)
    said = F.array_join("words", " ")
    versioned = F.array(*[F.lit(name in VERSIONS) for name, _ in templates])
    signed = F.array_compact(F.array(*[F.when(said.rlike(VERSIONS[name]) if name in VERSIONS else F.lit(True), F.lit(k)) for k, (name, _) in enumerate(templates)]))
    rows = each.withColumn("scores", scores).join(units.select(*key, signed.alias("signed")), key)
    fits = lambda x: F.array_contains("signed", -x["place"]) & (x["score"] >= F.when(~body(x), F.lit(like)).when(F.get(versioned, -x["place"]), F.lit(WHOLE_LIKE)).otherwise(BODY_LIKE))
    legal = F.exists("scores", lambda x: body(x) & (x["score"] >= like))
    best = rows.groupBy("_row").agg(F.max(F.array_max(F.filter("scores", fits))).alias("best"), F.bool_or(legal).alias("legal"))
    return best.where("best is not null and (best.licence or not legal)").select("_row", "best")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def statements(files: DataFrame, scratch: Scratch, templates=TEMPLATES, like: float = LIKE, bodies=WHOLE) -> DataFrame:
    """files: (key columns, path, text).  Adds directory, is_licence_file, own_place and own_score (null without a statement), and drops the text."""
    counted = template_terms(templates)
    every = [*counted, *bodies]
    vocabulary = sorted({t for _, c in every for t in c})
    frequencies = scratch.stage(document_frequencies(files), "frequencies")
    n = files.count()
    met = {r["term"]: r["df"] for r in frequencies.where(F.col("term").isin(vocabulary)).collect()}
    idf = {t: weight(n, met.get(t, 0)) for t in vocabulary}
    of_lines = {t: idf[t] for t in sorted({t for _, c in counted for t in c})}
    heaviest = heavy_terms(counted, idf, like)
    heavy = F.array(*map(F.lit, heaviest))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("path", F.lit("")), "([^/]*)$", 1), r"[.\-_].*$", ""))
    named = files.withColumn("is_licence_file", F.col("path").isNotNull() & base.isin(*LICENCE_NAMES))
    lines = F.transform(F.split(text, "\n"), terms_of)
    none = F.array().cast("array<array<string>>")
    asked = F.filter(lines, lambda w: F.arrays_overlap(w, heavy))
    # Most files hold no heavy term at all; for them no line is split.
    some = text.rlike(whole_terms(heaviest))
    alike = F.filter(F.when(some, asked).otherwise(none), lambda w: can_be_like(w, counted, of_lines, like))
    unit = lambda whole: lambda w: F.struct(F.lit(whole).alias("whole"), w.alias("words"))
    file = F.when(F.col("is_licence_file"), F.array(terms_of(text))).otherwise(none)
    units = F.concat(F.transform(alike, unit(False)), F.transform(file, unit(True)))
    rest = [c for c in files.columns if c != "text"]
    asking = scratch.stage(named.select(*rest, "is_licence_file", _parent(F.col("path")).alias("directory"), F.monotonically_increasing_id().alias("_row"), units.alias("units")), "units")
    best = best_templates(asking.select("_row", F.posexplode("units").alias("unit", "u")).select("_row", "unit", "u.*"), frequencies, n, every, idf, len(counted), like, scratch)
    found = asking.drop("units").join(best, "_row", "left")
    return found.select(*rest, "is_licence_file", "directory", (-F.col("best.place")).alias("own_place"), F.col("best.score").alias("own_score"))


def nearest_declared(directories: DataFrame, declared: DataFrame) -> DataFrame:
    """(directory, from_directory, place): the nearest declaring directory at or above each.

    directories: distinct; declared: (from_directory, place), one row a directory.
    """
    parts = F.split("directory", "/")
    above = directories.select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from_directory")))).alias("a")).select("directory", "a.*")
    met = above.join(declared, "from_directory")
    return met.groupBy("directory").agg(F.max_by(F.struct("from_directory", "place"), "depth").alias("m")).select("directory", "m.*")


def license_scan(files: DataFrame, templates=TEMPLATES, like: float = LIKE, bodies=WHOLE) -> DataFrame:
    """files: (key columns, path, text).  One row a file: key columns, path, licence, basis (own, inherited, none), score, from_directory."""
    keys = [c for c in files.columns if c not in ("path", "text", *RESULT)]
    files = files.select(F.struct(*keys).alias("keys") if keys else F.lit(0).alias("keys"), "path", "text")
    scratch = Scratch(files.sparkSession)
    found = scratch.stage(statements(files, scratch, templates, like, bodies), "statements")
    scratch.forget("frequencies", "shares", "units")
    declared = found.where("is_licence_file and own_place is not null").groupBy("directory").agg(F.max_by("own_place", F.struct("own_score", -F.col("own_place"))).alias("place")).withColumnRenamed("directory", "from_directory")
    directories = found.where("directory is not null").select("directory").distinct()
    inherited = scratch.stage(nearest_declared(directories, scratch.stage(declared, "declared")), "inherited")
    names = F.array(*[F.lit(n) for n, _ in [*templates, *bodies]])
    both = found.join(inherited, "directory", "left")
    place = F.coalesce("own_place", "place")
    out = both.select(
        *[F.col("keys")[c].alias(c) for c in keys], "path", F.when(place.isNotNull(), F.get(names, place.cast("int"))).alias("licence"), F.when(F.col("own_place").isNotNull(), "own").when(F.col("place").isNotNull(), "inherited").otherwise("none").alias("basis"),
        "own_score", F.when(F.col("own_place").isNull(), F.col("from_directory")).alias("from_directory"),
    )
    out = scratch.stage(out, "licences")
    scratch.drop("statements", "declared", "inherited")
    return out
