"""License scans, in DataFrame functions only.

Headers, notices and licence files are cut into statements (lines, and sentences
in them) and those with a licence word (``CUE``) are compared with templates as
sparse TF-IDF vectors by cosine.  Document frequencies count every statement of
the corpus.  A row's licence is its best statement's, at ``LEAST`` or more.

A row whose name says so (LICENSE, COPYING, NOTICE, ...) or of whose words statements with
a licence make ``FILE_SHARE`` or more is a licence file: its directory's licence.
Rows without a licence of their own inherit that of the nearest ancestor directory,
by an equi-join of each directory's ancestors with the licence files'
directories.

Equal statements are compared once, and directories are resolved once each, however
many rows have them; joins back to rows broadcast only tables counted to be small.

Defined results: null text has no statement; null paths are in no directory and inherit nothing;
ties of cosine go to the first licence by name, ties of licence files to the higher
score, then the first path; repeated rows give equal rows; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.llm.shared import saved, small

LEAST = 0.6
FILE_SHARE = 0.2
CUE = r"(?i)licen[cs]|copyright|spdx|warrant|permission is|redistribut|public domain|creative commons|cc by|cc0"
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)([._-][^/]*)?$"
#: The notices by which licences are known.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def _statements(text: Column) -> Column:
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    return F.when(text.rlike(CUE), F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x.rlike(CUE)))


def templates(spark: SparkSession) -> DataFrame:
    rows = ", ".join("('{}', '{}', {})".format(name, text.replace("'", "\\'"), i) for i, (name, text) in enumerate(TEMPLATES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(license, notice, template)")


def _counted(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(_terms(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def score_statements(statements: DataFrame) -> DataFrame:
    """(statement, license, score) of distinct statements; statements: (statement, n), n being how often each occurs."""
    spark = statements.sparkSession
    found = _counted(statements, "statement", "statement", "n")
    seen = found.groupBy("term").agg(F.sum("n").alias("df"))
    total = statements.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    idf = (F.log((1.0 + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf")
    seen = small(saved(seen))

    def vectors(counts: DataFrame, *keys: str) -> DataFrame:
        return counts.join(seen, "term", "left").select(*keys, "term", (F.col("tf") * idf).alias("w"))

    own = vectors(found, "statement")
    # templates are a fixed table of about 250 terms
    known = saved(vectors(_counted(templates(spark), "notice", "license", "template"), "license", "template"), 1)
    size = known.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_size"))
    known = F.broadcast(known.withColumnRenamed("w", "t_w").join(F.broadcast(size), "template"))
    whole = own.groupBy("statement").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = own.join(known, "term").groupBy("statement", "license", "template", "t_size").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    scored = dots.join(whole, "statement").withColumn("score", F.round(F.col("dot") / (F.col("size") * F.col("t_size")), 6))
    best = scored.groupBy("statement", "license").agg(F.max("score").alias("score")).where(F.col("score") >= LEAST)
    return best.groupBy("statement").agg(F.min_by("license", F.struct(-F.col("score"), "license")).alias("license"), F.max("score").alias("score"))


def _ancestors(directory: Column) -> Column:
    """A directory and all those above it, as an array; the root is ''."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """One row per row of docs: id, path, own_license, score, license, inherited_from (null where it has its own or none)."""
    text, path = F.coalesce(docs[text_col], F.lit("")), docs[path_col]
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select(docs[id_col].alias("id"), path.alias("path"), words.alias("words"), _statements(text).alias("statements"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    rows = saved(rows.withColumn("dir", F.when(F.col("path").isNotNull(), F.col("dir"))))

    said = rows.select("row", F.explode("statements").alias("statement"))
    scores = small(saved(score_statements(said.groupBy("statement").agg(F.count("*").alias("n")))))
    matched = said.join(scores, "statement").withColumn("length", F.regexp_count("statement", F.lit(r"[^\x20\x09-\x0D]+")))
    own = matched.groupBy("row").agg(F.min_by("license", F.struct(-F.col("score"), "license")).alias("own_license"), F.max("score").alias("score"), F.sum("length").alias("licensed"))
    rows = saved(rows.drop("statements").join(own, "row", "left"))

    is_file = F.col("path").rlike(FILE_NAME) | (F.col("licensed") >= FILE_SHARE * F.col("words"))
    files = rows.where(F.col("own_license").isNotNull() & F.col("dir").isNotNull() & is_file)
    files = files.groupBy(F.col("dir").alias("above")).agg(F.min_by("own_license", F.struct(-F.col("score"), "path", "own_license")).alias("dir_license"))
    above = rows.where("dir is not null").select("dir").distinct().withColumn("above", F.explode(_ancestors(F.col("dir"))))
    nearest = above.join(small(saved(files)), "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), F.length("above")).alias("near"))
    out = rows.join(small(saved(nearest)), "dir", "left")
    bare = F.col("own_license").isNull()
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "score", F.coalesce("own_license", "near.dir_license").alias("license"), F.when(bare, F.col("near.above")).alias("inherited_from"))


#: DuckDB SQL for the registered query, over documents with the path /source/lang/doc_id.txt.
ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, '/' || source || '/' || lang AS dir, coalesce(text, '') AS body FROM documents),
said AS (SELECT row_id, trim(s) AS statement FROM (SELECT row_id, unnest(string_split(regexp_replace(body, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM docs WHERE regexp_matches(body, '{cue}')) WHERE regexp_matches(trim(s), '{cue}')),
distinct_said AS (SELECT statement, count(*) AS n FROM said GROUP BY statement),
templates(license, notice, template) AS (VALUES {templates}),
found AS (SELECT statement, n, term, count(*) AS tf FROM (SELECT statement, n, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM distinct_said) GROUP BY ALL),
seen AS (SELECT term, sum(n) AS df FROM found GROUP BY term),
total AS (SELECT coalesce(sum(n), 0) AS total FROM distinct_said),
own AS (SELECT statement, term, tf * (ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0) AS w FROM found LEFT JOIN seen USING (term), total),
counted AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM templates) GROUP BY ALL),
known AS (SELECT license, template, term, tf * (ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0) AS w FROM counted LEFT JOIN seen USING (term), total),
t_size AS (SELECT template, sqrt(sum(w * w)) AS t_size FROM known GROUP BY template),
size AS (SELECT statement, sqrt(sum(w * w)) AS size FROM own GROUP BY statement),
scored AS (SELECT o.statement, k.license, k.template, sum(o.w * k.w) AS dot FROM own o JOIN known k USING (term) GROUP BY ALL),
best AS (SELECT statement, license, max(round(dot / (size * t_size), 6)) AS score FROM scored JOIN size USING (statement) JOIN t_size USING (template) GROUP BY ALL HAVING max(round(dot / (size * t_size), 6)) >= {least}),
scores AS (SELECT statement, arg_min(license, (-score, license)) AS license, max(score) AS score FROM best GROUP BY statement),
own_license AS (SELECT row_id, arg_min(license, (-score, license)) AS own_license, max(score) AS score, sum(len(regexp_extract_all(statement, '[^\\x20\\x09-\\x0D]+'))) AS licensed FROM said JOIN scores USING (statement) GROUP BY row_id),
rows AS (SELECT d.*, o.own_license, o.score, o.licensed FROM docs d LEFT JOIN own_license o USING (row_id)),
files AS (SELECT dir AS above, arg_min(own_license, (-score, path, own_license)) AS dir_license FROM rows WHERE own_license IS NOT NULL AND licensed >= {share} * len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) GROUP BY dir),
nearest AS (SELECT d.dir, arg_max(f.above, length(f.above)) AS above, arg_max(f.dir_license, length(f.above)) AS dir_license FROM (SELECT DISTINCT dir FROM rows) d JOIN files f ON d.dir = f.above OR starts_with(d.dir, f.above || '/') GROUP BY d.dir)
SELECT doc_id, path, own_license, score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from FROM rows LEFT JOIN nearest USING (dir)
"""


def oracle() -> str:
    rows = ", ".join("('{}', '{}', {})".format(name, text.replace("'", "''"), i) for i, (name, text) in enumerate(TEMPLATES))
    return ORACLE.format(cue=CUE, templates=rows, least=LEAST, share=FILE_SHARE)
