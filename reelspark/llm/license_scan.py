"""License scans by diagonal voting, from DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.llm.common import lower_ascii

#: Phrases whose words must stand consecutively, and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further wordings by label; a span of words that agrees with one of them well enough is a find.
OTHERS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is marked with cc0 1 0 universal": "cc0",
    # whole texts, as words
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is"
    " without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors"
    " or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or"
    " other dealings in the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in"
    " all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall"
    " the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or"
    " other tortious action arising out of or in connection with the use or performance of this software": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above"
    " copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including"
    " but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct"
    " indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however"
    " caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the"
    " possibility of such damage": "bsd",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to"
    " anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not"
    " be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this"
    " notice may not be removed or altered from any source distribution": "zlib",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled"
    " binary for any purpose commercial or non commercial and by any means": "unlicense",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals that lie at most so far apart belong to one span (words put in or left out).
APART = 2


def templates(spark: SparkSession, base: dict[str, str], others: dict[str, str]) -> DataFrame:
    """(template, label, base, words, t_pos, gram): a row for each word k-gram; bounded by the two lists."""
    rows = [(i, label, p in base, p.split()) for i, (p, label) in enumerate([*base.items(), *others.items()])]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, t_words array<string>")
    at = F.explode(F.sequence(F.lit(0), F.size("t_words") - GRAM)).alias("t_pos")
    t = t.select("*", at)
    return t.withColumn("gram", F.xxhash64(*[F.get("t_words", F.col("t_pos") + i) for i in range(GRAM)]))


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, others: dict[str, str] = OTHERS, least: float = 0.7
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of digits, letters and characters beyond ASCII, after A-Z are lower-cased; null texts
    are empty. Every word 3-gram's hash is joined to the templates' positions; a hit votes for the
    diagonal word position - template position, where the words are compared with the template's one by
    one. Diagonals of a template at most 2 apart make one span. Its share is the number of the template's words that agree on it, of
    those of the template or, if it is longer, of the stretch of text from the first that agrees to the last; a span with `least` or more is a find. n_base counts the places where all words of a base phrase stand,
    first_word and last_word are their smallest and largest start (null without any). labels has the base
    labels and those of all finds; score is the largest share of agreeing words of any span, 1 for a base
    phrase, 0 without a hit. spans lists the finds (label, first word, last word, share) in order.
    Repeated rows and null ids each give their own row; other columns are ignored; no rows give none.
    A phrase must have at least 3 words.
    """
    if any(len(p.split()) < GRAM for p in [*base, *others]):
        raise ValueError(f"a phrase needs at least {GRAM} words")
    t = templates(docs.sparkSession, base, others)
    # One row for each document that hits nothing: a gram of its own, so that one pass over the texts is enough.
    mark = docs.sparkSession.createDataFrame([(-1, None, False, [], 0, 0)], t.schema)
    words = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("words")
    )
    gram = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, GRAM)]))
    # The hashes are a column of their own before they are spread out: a row of the join then only refers to
    # its document's words, and nothing but the few words of a hit is ever copied. The array is never empty; the
    # outer form keeps the optimizer from testing that with a second copy of the expression, words and all.
    grams = words.withColumns({"n_words": F.size("words").cast("long"), "grams": F.concat(F.array(F.lit(0).cast("long")), gram)})
    grams = grams.select("doc_id", "row", "words", "n_words", F.posexplode_outer("grams").alias("at", "gram"))
    span = F.slice("words", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.size("t_words"))
    # A diagonal may begin before the text; its words are then moved along by as many empty places.
    shift = F.greatest(-F.col("diagonal"), F.lit(0))
    equal = F.filter(F.transform("t_words", lambda w, i: F.when(F.get("span", i - F.col("shift")).eqNullSafe(w), i)), lambda i: i.isNotNull())
    hits = (
        grams.join(F.broadcast(t.union(mark)), "gram")
        .where("(at = 0) = (template = -1) and (at = 0 or at <= n_words - 2)")
        .withColumn("diagonal", F.col("at") - 1 - F.col("t_pos"))
        .select("doc_id", "row", "n_words", "template", "label", "base", "t_words", "diagonal", F.size("t_words").alias("size"), F.when(F.col("at") > 0, span).alias("span"))
        .repartition("row")
        .withColumn("shift", shift)
        .withColumn("equal", equal)
    )
    key = ["doc_id", "row", "n_words", "template", "label", "base", "size"]
    voted = hits.groupBy(*key, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.max("equal").alias("equal"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(by) <= APART
    reach = {"low": F.col("diagonal") + F.array_min("equal"), "high": F.col("diagonal") + F.array_max("equal")}
    voted = voted.withColumns(reach)
    islands = voted.withColumn("island", F.sum(F.when(near & ~F.col("base"), 0).otherwise(1)).over(by))
    spans = islands.groupBy(*key, "island").agg(F.min("diagonal").alias("start"), F.max("diagonal").alias("last"), F.sum("votes").alias("votes"), F.max(F.size("equal")).alias("agree"), F.collect_list("equal").alias("equal"), (F.max("high") - F.min("low") + 1).alias("stretch"))
    # Words that agree on neighbouring diagonals add up, each word of the template once.
    share = F.size(F.array_distinct(F.flatten("equal"))) / F.greatest("size", "stretch")
    spans = spans.withColumn("share", F.when(F.col("template") >= 0, share).otherwise(0.0)).withColumn("place", F.col("base") & (F.col("agree") == F.col("size")))
    found = F.col("place") | (~F.col("base") & (F.col("share") >= least))
    start = F.when(F.col("place"), F.col("start").cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        joined(F.when(F.col("place"), F.col("label"))).alias("base_labels"),
        joined(F.when(found, F.col("label"))).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct(F.greatest("start", F.lit(0)).alias("first"), (F.col("last") + F.col("size") - 1).alias("last"), "label", "share")))).alias("spans"),
    ).drop("row")
