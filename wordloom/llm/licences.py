"""License scans (7), in DataFrame operations only: a positional index of rare licence words.

Templates are short notices and whole licence texts, as words with a label and a key phrase that must stand word for
word. Each text is split once; what stays of it, staged, is its licence vocabulary by place. The document frequency of
every template word comes from that table; of each template the words of highest inverse frequency are posted with their
relative positions, two more than may be missing from a place that is similar enough. A text's posted words, its rarest
licence words, are looked up; where two postings of a template agree on the place it would begin at (an intersection by
relative position: hits are sorted, so it takes time by their number), that is a candidate, and it is verified: its key
phrase first, then the share of template words in place. No place of the least similarity can have under two such words.

Base templates need every word. A null or empty text has no words, no labels and score 0. An empty table gives an empty
result. Each row stands for itself, repeated or not; places of equal share all count. Whole texts are searched. Columns
of the input stay, those named like results give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, besides, staged, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least share of a template's words in place.
SIMILAR = 0.8
#: Postings that must agree on a place.
AGREE = 2
#: Added to places, which may lie before a text's beginning.
_BEFORE = 1 << 20
#: Base phrases and labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Further notices: words, label, key phrase.
NOTICES = [
    ("gnu general public license version 3", "gpl-3.0", "public license version 3"),
    ("gnu general public license version 2", "gpl-2.0", "public license version 2"),
    ("gnu lesser general public license", "lgpl", "lesser general public license"),
    ("gnu affero general public license", "agpl", "affero general public license"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("mozilla public license version 2 0", "mpl-2.0", "mozilla public license"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary forms"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "hereby granted free of charge"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", "permission to use copy modify"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
    ("all rights reserved", "all-rights-reserved", "all rights reserved"),
    # Whole texts and standard headers
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit-text", "hereby granted free of charge"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd-text", "source and binary forms"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc-text", "permission to use copy modify"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0-header", "apache license version 2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3.0-header", "gnu general public license"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2.0-header", "mozilla public license"),
]


def templates() -> list[dict]:
    """Of each template its words, label, whether it is a base one, how many words must be in place, and its key's place."""
    out = [{"words": p.split(), "label": label, "base": True, "least": len(p.split()), "key": 0, "key_len": len(p.split())} for p, label in BASE]
    for text, label, key in NOTICES:
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append({"words": words, "label": label, "base": False, "least": math.ceil(round(len(words) * SIMILAR, 6)), "key": at, "key_len": len(phrase)})
    return out


def words_of(text: Column) -> Column:
    """Words in lower case. Beyond ASCII lower() may change letters, but no word of a template can come of that but by K, the Kelvin sign."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def rarity(held: DataFrame) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands: as many rows at most."""
    return {r.w: r["count"] for r in held.select(F.explode(F.array_distinct(F.array_compact(f"{OWN}held"))).alias("w")).groupBy("w").count().collect()}


def postings(found: list[dict], seen: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word: [(template, relative position)] of each template's rarest words, AGREE more than a similar place may lack, less one."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, x in enumerate(found):
        by_rarity = sorted(range(len(x["words"])), key=lambda i: (seen.get(x["words"][i], 0), i))
        for i in by_rarity[: len(x["words"]) - x["least"] + AGREE]:
            index.setdefault(x["words"][i], []).append((t, i))
    return index


def places(docs: DataFrame, found: list[dict] | None = None, with_text: bool = True) -> DataFrame:
    """docs with n_words and places: array<struct<at, label, base, share>> of all verified places; columns of these names give way.

    Templates have AGREE words at least. Texts are staged with the rest if they are asked for.
    """
    docs = besides(docs, "n_words", "places")
    found = found or templates()
    vocabulary = sorted({w for x in found for w in x["words"]})
    own = [F.col(f"`{c}`") for c in docs.columns if with_text or c.lower() != "text"]
    held = docs.select(*own, F.transform(words_of(F.col("text")), lambda w: F.when(w.isin(vocabulary), w)).alias(f"{OWN}held"))
    held = staged(held, "licence-words")
    index = postings(found, rarity(held))
    known = F.array(*(F.struct(F.array(*map(F.lit, x["words"])).alias("words"), F.lit(x["label"]).alias("label"), F.lit(x["base"]).alias("base"), F.lit(x["least"]).alias("least"), F.lit(x["key"]).alias("key"), F.lit(x["key_len"]).alias("key_len")) for x in found))
    # A template's number, and where it would begin less its posting's place, in one number
    posted = F.create_map(*(y for w, ps in index.items() for y in (F.lit(w), F.array(*(F.lit((t << 32) + _BEFORE - r) for t, r in ps)))))
    words, hits = F.col(f"{OWN}held"), f"{OWN}hits"
    rare = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(index)), F.struct(i.cast("long").alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    out = held.withColumn(hits, F.array_sort(F.flatten(F.transform(rare, lambda x: F.transform(F.element_at(posted, x["w"]), lambda p: p + x["i"])))))
    same = lambda x, i: x == F.get(hits, i - (AGREE - 1))
    agreed = F.filter(hits, lambda x, i: same(x, i) & ~F.coalesce(x == F.get(hits, i - AGREE), F.lit(False)))
    out = out.withColumn(f"{OWN}candidates", F.transform(agreed, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("t"), (x.bitwiseAND(F.lit((1 << 32) - 1)) - _BEFORE).cast("int").alias("at"))))

    def verified(c: Column) -> Column:
        x = F.get(known, c["t"])
        key = F.slice(x["words"], x["key"] + 1, x["key_len"]) == F.slice(words, F.greatest(c["at"] + x["key"] + 1, F.lit(1)), x["key_len"])
        in_place = F.size(F.filter(F.transform(x["words"], lambda w, i: w.eqNullSafe(F.get(words, c["at"] + i))), lambda same: same))
        inside = c["at"] + x["key"] >= 0
        share = F.when(inside, F.when(key, F.when(in_place >= x["least"], in_place / F.size(x["words"]))))
        return F.struct(c["at"].alias("at"), x["label"].alias("label"), x["base"].alias("base"), F.coalesce(share, F.lit(0.0)).alias("share"))

    checked = F.when(F.size(f"{OWN}candidates") > 0, F.filter(F.transform(f"{OWN}candidates", verified), lambda p: p["share"] > 0)).otherwise(F.expr("cast(array() as array<struct<at:int,label:string,base:boolean,share:double>>)"))
    return out.select(*held.drop(f"{OWN}held").columns, F.size(words).cast("long").alias("n_words"), checked.alias("places"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = places(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["at"].cast("long"))
    joined = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    return docs.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """Places found by their key phrases, without an index."""
    rows = ", ".join(f"({x['words']}, '{x['label']}', {x['base']}, {x['least']}, {x['key']}, {x['words'][x['key'] : x['key'] + x['key_len']]})" for x in templates())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(words, label, base, least, key, phrase) AS (VALUES {rows}),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, w, i - key - 1 AS pos, words, label, base, least FROM p JOIN t ON w[i] = phrase[1] WHERE w[i:i + len(phrase) - 1] = phrase),
s AS (
  SELECT doc_id, pos, label, base, least, len(words) AS n,
    len(list_filter(range(1, len(words) + 1), lambda j: pos + j >= 1 AND coalesce(w[pos + j], '') = words[j])) AS same FROM k),
f AS (SELECT * FROM s WHERE same >= least),
g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(same / n) AS score
  FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (doc_id)
"""
