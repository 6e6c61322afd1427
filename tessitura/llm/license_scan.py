"""License scans by diagonal voting, in DataFrame functions alone.

Every rolling run of words of every document is hashed and joined with the places of such runs in the templates; votes
are counted on the diagonal (place in the document less place in the template), neighbouring diagonals are merged, and
a span is verified by its words: how many different places of the template stand in it, in the template's order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import ascii_lower, whole_text

# Phrases whose every place counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices that the scan knows besides, by label; found if enough of their runs of words stand near one diagonal.
NOTICES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided "as is", without warranty of any kind,
        express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the
        authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in
        connection with the Software or the use or other dealings in the Software.""",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at""",
    "gpl-3.0": "This work is licensed under the GNU General Public License version 3",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version.""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc": "This work is licensed under a Creative Commons Attribution",
    "mpl": "Subject to the terms of the Mozilla Public License",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at""",
    "all-rights-reserved": "All rights reserved",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a run: two in phrases (some have no more), three in notices.
PAIR, RUN = 2, 3
#: Hash of no run: marks the row that carries a document through the join.
MARK = -1
#: Stands for a word that isn't there; no word has it.
NONE = "\x00"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if c < "\x80" else c for c in text))


def template_rows(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[tuple]:
    """(template, place, runs that it has, label, base, first word, second, third or null) for each run of words of each template."""
    out = []
    for t, (text, label, base) in enumerate([*((k, v, True) for k, v in phrases.items()), *((v, k, False) for k, v in notices.items())]):
        w, n = words_of(text), PAIR if base else RUN
        if len(w) < n:
            raise ValueError(f"a template needs {n} words: {text}")
        out += [(t, i, len(w) - n + 1, label, base, w[i], w[i + 1], None if base else w[i + 2]) for i in range(len(w) - n + 1)]
    return out


def templates(spark, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each run of each template, with the hash of its first two words, and the mark. A fixed, small table."""
    rows = spark.createDataFrame(template_rows(phrases, notices), "tid int, tpos int, need int, label string, base boolean, w1 string, w2 string, w3 string")
    mark = spark.sql(f"select -1 as tid, 0 as tpos, 1 as need, '' as label, false as base, cast(null as string) as w1, cast(null as string) as w2, cast(null as string) as w3, {MARK}L as g")
    return rows.withColumn("g", F.xxhash64("w1", "w2")).unionByName(mark)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, coverage: float = 0.8, drift: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, spans (array<struct<label,base,start,coverage>>), score (largest coverage of any span).

    A phrase of ``phrases`` (label by text) gives a span at each place where its words stand consecutively. A notice of ``notices`` (text by label) gives a
    span where neighbouring diagonals, at most ``drift`` apart, together hold ``coverage`` of its runs of three words: of each run the first place counts,
    once, and only where it stands after the place of the run before it that is there. Hashes propose; a vote counts if the words are the template's.

    Defined cases: null and empty texts have no words, no spans and score 0; very long texts are scanned whole; rows with null or repeated ids stay rows of
    their own; an empty table gives an empty table; other columns aren't read."""
    spark = docs.sparkSession
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.regexp_extract_all(ascii_lower(whole_text(text_col)), F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    # The word before the first, which no text can have, makes the row that carries its document through the join.
    marked = words.select("row", "id", F.concat(F.array(F.lit(NONE)), "w").alias("w"))
    second = F.coalesce(F.get("w", F.col("pos") + 1), F.lit(NONE))
    grams = marked.select("row", "id", "w", F.posexplode("w").alias("pos", "a")).select(
        "row", "id", "a", second.alias("b"), F.coalesce(F.get("w", F.col("pos") + 2), F.lit(NONE)).alias("c"),
        F.when(F.col("pos") == 0, F.size("w")).otherwise(F.col("pos")).alias("pos"), F.when(F.col("pos") == 0, F.lit(MARK).cast("long")).otherwise(F.xxhash64("a", second)).alias("g"),
    )
    # The templates are a parameter of fixed size (some hundred rows), so they are broadcast.
    same = (F.col("a") == F.col("w1")) & (F.col("b") == F.col("w2")) & (F.col("w3").isNull() | (F.col("c") == F.col("w3")))
    votes = (
        grams.join(F.broadcast(templates(spark, phrases, notices)), "g").filter((F.col("tid") < 0) | same)
        .select("row", "id", "tid", "need", "label", "base", "tpos", (F.col("pos") - 1 - F.col("tpos")).alias("diag"))
        .repartition("row")
    )
    key = ["row", "id", "tid", "need", "label", "base"]
    diagonals = votes.groupBy(*key, "diag").agg(F.collect_set("tpos").alias("places"))
    order = Window.partitionBy(*key).orderBy("diag")
    fresh = F.col("base") | F.coalesce(F.col("diag") - F.lag("diag").over(order) > drift, F.lit(True))
    merged = (
        diagonals.withColumn("new", fresh.cast("int")).withColumn("span", F.sum("new").over(order)).groupBy(*key, "span")
        .agg(F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda t: F.struct(t.alias("tpos"), (F.col("diag") + t).alias("pos")))))).alias("v"), F.min("diag").alias("diag"))
    )
    firsts = merged.withColumn("f", F.filter("v", lambda x, i: (i == 0) | (F.get("v", i - 1)["tpos"] != x["tpos"])))
    counted = firsts.withColumn("cov", F.size(F.filter("f", lambda x, i: (i == 0) | (F.get("f", i - 1)["pos"] < x["pos"]))) / F.col("need"))
    verified = counted.filter((F.col("tid") < 0) | (F.col("cov") >= F.when(F.col("base"), 1.0).otherwise(coverage)))
    real = F.col("tid") >= 0
    return verified.groupBy("row", "id").agg(
        F.max(F.when(~real, F.col("diag"))).cast("long").alias("n_words"),
        F.collect_list(F.when(real, F.struct("label", "base", F.col("diag").cast("long").alias("start"), F.col("cov").alias("coverage")))).alias("spans"),
        F.coalesce(F.max(F.when(real, F.col("cov"))), F.lit(0.0)).alias("score"),
    ).select(F.col("id").alias(id_col), "n_words", "spans", "score")
