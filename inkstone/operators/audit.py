"""The audit of papers: issues of sentences, alignment, score, lexical statistics and their order.

All operators take any number of papers at once: sentences are rows (doc, sentence_id, page,
text, lang), the library's artifacts are tables that are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import headings, lexicon
from inkstone.functions import text as T
from inkstone.operators import documents, structure, style

#: Rank of the types of issues, and what counts as style.
RANKS = {
    "semantic_outlier": 520, "uncommon_phrasing": 440, "syntax_outlier": 420, "ai_transition": 320, "template": 300, "redundancy": 280, "repetition": 260,
    "punctuation": 240, "long_sentence": 180, "short_sentence": 160, "ai_word": 120, "passive": 110,
}
STYLE_TYPES = ["ai_transition", "ai_word", "template", "passive", "long_sentence"]
_SHAPE = ["doc", "sentence_id", "issue_type", "severity", "matched"]


def split_pages(pages: DataFrame, first: int = 3) -> DataFrame:
    """(doc, sentence_id, page, text, lang): the sentences of paged papers, numbered from 0 through each paper.

    The language of a paper is that of its first pages; the pages of a mixed one have their own.
    """
    from inkstone.functions import segment
    from inkstone.operators.pages import languages_of

    clean = pages.withColumn("text", segment.join_soft_breaks(F.col("text"))).join(languages_of(pages, first=first), "doc")
    lang = F.when(F.col("language") == "mixed", T.language(F.col("text"))).otherwise(F.col("language"))
    rows = segment.with_sentences(clean.select("doc", "page", "text", lang.alias("_l")), "text", F.col("_l"), "s")
    out = rows.select("doc", "page", "_l", F.posexplode("s").alias("_i", "_s")).select("doc", "page", "_l", "_i", F.col("_s.text").alias("text"))
    n = F.row_number().over(W.partitionBy("doc").orderBy("page", "_i")) - 1
    s = T.sentence_language(F.col("text"))
    known = F.col("text").rlike("[A-Za-z\\x{4e00}-\\x{9fff}]")
    return out.select("doc", n.alias("sentence_id"), "page", "text", F.when(known, s).when(F.col("_l") == "mixed", "en").otherwise(F.col("_l")).alias("lang"))


def _issue(df: DataFrame, kind: str, severity: str | Column, matched: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("doc", "sentence_id", F.lit(kind).alias("issue_type"), level.alias("severity"), matched.alias("matched"))


def style_issues(sentences: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Length, transitions, and of Chinese and mixed sentences typical words, passives and templates; headings have none.

    ``means``: (lang en or zh, mean) sentence lengths of the library, else 25 words and 20 characters.
    """
    s = sentences.where(~headings.heading_like(F.col("text"), F.col("lang"))).select("doc", "sentence_id", "text", "lang")
    zh, en = F.col("lang").isin("zh", "mixed"), F.col("lang").isin("en", "mixed")
    if means is None:
        sized = s.withColumn("mean", F.when(zh, 20.0).otherwise(25.0))
    else:
        m = means.select(F.col("lang").alias("_m"), "mean").where("mean > 0")
        sized = s.withColumn("_m", F.when(zh, "zh").otherwise("en")).join(F.broadcast(m), "_m", "left")  # two rows
        sized = sized.withColumn("mean", F.coalesce("mean", F.when(zh, 20.0).otherwise(25.0)))
    size = F.when(zh, T.han_count(F.col("text"))).otherwise(F.size(T.ascii_words(F.col("text"))))
    long_ = _issue(sized.where(style.too_long(size, F.col("mean"))), "long_sentence", "info", F.lit(""))
    word = F.col("term")
    out = long_.unionByName(_issue(style.contained(s.where(zh), "text", lexicon.TRANSITIONS_ZH, "ai_transition"), "ai_transition", "warning", word))
    out = out.unionByName(_issue(style.contained(s.where(en), "text", lexicon.TRANSITIONS_EN, "ai_transition", True), "ai_transition", "warning", word))
    out = out.unionByName(_issue(style.contained(s.where(zh), "text", lexicon.AI_WORDS_ZH, "ai_word"), "ai_word", "info", word))
    passive = s.where(zh).withColumn("m", style.passive_zh(F.col("text"))).where("m IS NOT NULL")
    out = out.unionByName(_issue(passive, "passive", "info", F.when(F.col("m").isin(*lexicon.PASSIVE_MARKERS_ZH), F.col("m")).otherwise("")))
    return out.unionByName(_issue(s.where(zh).withColumn("m", F.explode(style.templates_zh(F.col("text")))), "template", "info", F.col("m")))


def repetition(sentences: DataFrame, language: Column | None = None, least: int = 3) -> DataFrame:
    """Sentences of a paper that begin with the same three words (or Chinese tokens) as at least two others."""
    lang = F.lit("en") if language is None else language
    s = sentences.where((F.trim("text") != "") & ~headings.heading_like(F.col("text"), lang)).withColumn("_l", lang)
    en, zh = T.ascii_words(F.col("text")), T.han_tokens(F.col("text"))
    key = F.when(F.col("_l") == "zh", F.when(F.size(zh) >= 5, F.array_join(F.slice(zh, 1, 3), ""))).otherwise(F.when(F.size(en) >= 6, F.array_join(F.slice(en, 1, 3), " ")))
    k = s.select("doc", "sentence_id", key.alias("key")).where("key IS NOT NULL")
    often = k.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return _issue(k.join(often, ["doc", "key"]), "repetition", "info", F.col("key"))


def domain_issues(sentences: DataFrame, phrases: DataFrame | None, mean: Column, measured: Column, language: str = "en") -> DataFrame:
    """Short sentences, unbalanced brackets and uncommon phrases (against the library's ``bigram`` table) of papers in one language."""
    s = sentences.where(~headings.heading_like(F.col("text"), F.lit(language)))
    zh = language == "zh"
    tokens = T.han_tokens(F.col("text")) if zh else T.ascii_words(F.col("text"))
    size = F.size(tokens)
    floor_ = F.lit(10 if zh else 5)
    least = F.when((mean > 0) & measured, F.greatest(floor_, F.floor(mean * 0.45))).otherwise(floor_)
    out = _issue(s.where((size > 0) & (size < least)), "short_sentence", "info", F.lit(""))
    pair = s.withColumn("_b", T.unbalanced(F.col("text"))).where("_b IS NOT NULL")
    out = out.unionByName(_issue(pair, "punctuation", "info", F.col("_b")))
    if phrases is None:
        return out
    per = unseen_phrases(s, phrases, language).where((F.col("n") >= 8) & (F.col("unseen") >= 3) & (F.col("unseen") >= 0.25 * F.col("n")))
    warning = (F.col("unseen") >= 4) & (F.col("unseen") >= 0.33 * F.col("n"))
    return out.unionByName(_issue(per, "uncommon_phrasing", F.when(warning, "warning").otherwise("info"), F.array_join(F.slice("examples", 1, 3), " / ")))


def unseen_phrases(sentences: DataFrame, phrases: DataFrame, language: str = "en") -> DataFrame:
    """(doc, sentence_id, n, unseen, examples): adjacent pairs of sentences of four tokens or more, and those the library has not, in order."""
    tokens = T.han_tokens(F.col("text")) if language == "zh" else T.ascii_words(F.col("text"))
    rows = sentences.select("doc", "sentence_id", tokens.alias("w")).where(F.size("w") >= 4)
    pairs = rows.select("doc", "sentence_id", F.posexplode(T.bigrams(F.col("w"))).alias("at", "bigram"))
    j = pairs.join(phrases.select("bigram", F.lit(1).alias("known")).distinct(), "bigram", "left")
    odd = F.when(F.col("known").isNull(), F.struct("at", "bigram"))
    per = j.groupBy("doc", "sentence_id").agg(F.count(F.lit(1)).alias("n"), F.count(odd).alias("unseen"), F.sort_array(F.collect_list(odd)).alias("_o"))  # the pairs of one sentence
    return per.select("doc", "sentence_id", "n", "unseen", F.transform("_o", lambda x: x["bigram"]).alias("examples"))


def syntax_issues(tagged: DataFrame, known: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """Sentences (doc, sentence_id, text, lang, upos) whose tag pairs the library hardly has; only those of ``focus`` if given."""
    if focus is not None:
        tagged = tagged.join(focus.select("doc", "sentence_id").distinct(), ["doc", "sentence_id"], "left_semi")
    long_ = F.when(F.col("lang") == "zh", T.han_count(F.col("text")) >= 16).otherwise(F.size(T.ascii_words(F.col("text"))) >= 8)
    s = tagged.where(~headings.heading_like(F.col("text"), F.col("lang")) & long_ & (F.size("upos") >= 4))
    s = s.withColumn("_k", F.struct("doc", "sentence_id"))
    odd = documents.syntax_outliers(s, known, "_k", "upos")
    return _issue(odd.select("_k.*"), "syntax_outlier", "warning", F.lit(""))


def semantic_issues(hits: DataFrame, sentences: DataFrame, least: float = 0.68) -> DataFrame:
    """Sentences whose nearest library sentence (doc, sentence_id, score) is not near enough; short ones and headings are none."""
    zh = F.col("lang") == "zh"
    enough = F.when(zh, T.han_count(F.col("text")) >= 12).otherwise(F.size(T.ascii_words(F.col("text"))) >= 6)
    s = sentences.where(~headings.heading_like(F.col("text"), F.col("lang")) & enough).select("doc", "sentence_id")
    best = hits.groupBy("doc", "sentence_id").agg(F.max("score").alias("best")).where(F.col("best") < least)
    return _issue(s.join(best, ["doc", "sentence_id"]), "semantic_outlier", "warning", F.format_string("%.3f", F.col("best")))


def weirdness_en(sentences: DataFrame, vocabulary: DataFrame, phrases: DataFrame, docs: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc, score, level) of the papers in English among ``sentences`` (doc, sentence_id, text); ``docs``: one row, the library's size.

    The mean length is that of all English sentences; papers with more than ``share`` of Han letters are left out.
    """
    s = sentences.withColumn("zh", T.han_count(F.col("text"))).withColumn("en", T.latin_count(F.col("text"))).withColumn("w", T.ascii_words(F.col("text")))
    english = s.groupBy("doc").agg(F.sum("zh").alias("z"), F.sum("en").alias("e")).where((F.col("e") > 0) & (F.col("z") <= share * (F.col("z") + F.col("e")))).select("doc")
    mine = s.join(english, "doc")
    mean = s.where((F.col("zh") == 0) & (F.size("w") > 0)).agg(F.avg(F.size("w")).alias("mean"))
    t = mine.select("doc", F.explode(T.words(F.col("text"))).alias("token")).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("c"))
    t = t.join(vocabulary.select("token", "doc_freq"), "token", "left").crossJoin(F.broadcast(docs)).withColumn("df", F.coalesce("doc_freq", F.lit(0)))  # one row
    unseen = F.sum(F.when(F.col("df") == 0, F.col("c")).otherwise(0)) / F.sum("c")
    rare = F.sum(F.when((F.col("df") > 0) & (100.0 * F.col("df") / F.greatest("docs", F.lit(1)) < 10), F.col("c")).otherwise(0)) / F.sum("c")
    words = t.groupBy("doc").agg(unseen.alias("unseen"), rare.alias("rare"))
    plain = mine.where(~headings.heading_like(F.col("text"), F.lit("en")))
    per = unseen_phrases(plain, phrases)
    odd = (F.col("n") >= 8) & (F.col("unseen") >= 3) & (F.col("unseen") >= 0.25 * F.col("n"))
    phrase = per.groupBy("doc").agg((F.sum("unseen") / F.sum("n")).alias("ph"), F.count_if(odd).alias("odd"))
    sized = plain.crossJoin(F.broadcast(mean))  # one row
    size = F.size("w")
    short = (size > 0) & (size < F.greatest(F.lit(5), F.floor(F.col("mean") * 0.45)))
    low = F.lower("text")
    styled = style.too_long(size, F.col("mean")) | F.exists(F.array(*[F.lit(x.lower()) for x in lexicon.TRANSITIONS_EN]), lambda x: F.contains(low, x))
    shape = sized.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short"), F.count_if(T.unbalanced(F.col("text")).isNotNull()).alias("punct"), F.count_if(styled).alias("styled"))
    j = shape.join(words, "doc", "left").join(phrase, "doc", "left")
    zero = F.lit(0)
    sentence = F.least(F.lit(1.0), (F.col("short") + F.col("punct") + F.coalesce("odd", zero)) / F.col("n"))
    score = style.weirdness(F.coalesce("unseen", F.lit(0.0)), F.coalesce("rare", F.lit(0.0)), F.col("ph"), sentence, F.col("styled") / F.col("n"))
    return j.select("doc", score.alias("score")).select("doc", "score", style.level(F.col("score")).alias("level"))


def candidates(sentences: DataFrame, least: int = 20, most: int = 3600) -> DataFrame:
    """The sentences to be aligned: no headings, at least 20 characters, evenly drawn where a paper has more than ``most`` (50 to 3600)."""
    some = sentences.where((F.length(F.trim("text")) >= least) & ~headings.heading_like(F.col("text"), F.col("lang")))
    return structure.even_sample(some, F.col("sentence_id"), max(50, min(int(most), 3600)), "doc").drop("pos")


def low_alignment(aligned: DataFrame, least: float = 0.35) -> DataFrame:
    """Issues of aligned sentences (doc, sentence_id, score) below the threshold."""
    return _issue(aligned.where(F.col("score") < least), "low_alignment", "warning", F.lit(""))


def suggestions(aligned: DataFrame) -> DataFrame:
    """(doc, sentence_id, scaffold, pdf, page): the phrase worth keeping of the first exemplar of each aligned sentence."""
    first = F.get("exemplars", 0)
    s = aligned.select("doc", "sentence_id", documents.scaffold(first["text"], T.sentence_language(first["text"])).alias("scaffold"), first["pdf"].alias("pdf"), first["page"].alias("page"))
    return s.where(F.coalesce("scaffold", F.lit("")) != "")


def rank(issue_type: Column, severity: Column) -> Column:
    """The weight of an issue: a thousand more for a warning."""
    table = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, issue_type), F.lit(100)) + F.when(F.lower(severity) == "warning", 1000).otherwise(0)


def diagnoses(issues: DataFrame) -> DataFrame:
    """(doc, sentence_id, issues, warnings, top, position): issues of a sentence by weight, sentences by warnings, weight and order."""
    r = issues.withColumn("_r", rank(F.col("issue_type"), F.col("severity")))
    one = F.struct((-F.col("_r")).alias("r"), "issue_type", "severity", "matched")
    per = r.groupBy("doc", "sentence_id").agg(F.sort_array(F.collect_list(one)).alias("_i"), F.count_if(F.lower("severity") == "warning").alias("warnings"), F.max("_r").alias("top"))
    order = [F.desc(F.col("warnings") > 0), F.desc("warnings"), F.desc("top"), "sentence_id"]
    out = per.withColumn("position", F.row_number().over(W.partitionBy("doc").orderBy(*order)))
    shown = F.transform("_i", lambda x: F.struct(x["issue_type"].alias("issue_type"), x["severity"].alias("severity"), x["matched"].alias("matched")))
    return out.select("doc", "sentence_id", shown.alias("issues"), "warnings", "top", "position")


def at_position(sentences: DataFrame, positions: DataFrame) -> DataFrame:
    """(doc, pos, sentence_id): the sentence (doc, sentence_id, start, end) that holds a character position; at most one."""
    return positions.join(sentences.select("doc", "sentence_id", "start", "end"), "doc").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).select("doc", "pos", "sentence_id")


def items(sentences: DataFrame, issues: DataFrame, aligned: DataFrame, low: float = 0.35) -> DataFrame:
    """The sentences of papers that have an issue or are badly aligned, low ones first, then by score.

    (doc, sentence_id, page, text, lang, score, pct, issues, scaffold, position)
    """
    all_ = issues.select(*_SHAPE).unionByName(low_alignment(aligned, low))
    per = all_.groupBy("doc", "sentence_id").agg(F.sort_array(F.collect_list(F.struct("issue_type", "severity", "matched"))).alias("issues"))
    j = sentences.join(per, ["doc", "sentence_id"]).join(aligned.select("doc", "sentence_id", "score", "pct"), ["doc", "sentence_id"], "left")
    j = j.join(suggestions(aligned).select("doc", "sentence_id", "scaffold"), ["doc", "sentence_id"], "left")
    j = j.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("pct", F.coalesce("pct", F.lit(0)))
    is_low = F.exists("issues", lambda x: x["issue_type"] == "low_alignment")
    return j.withColumn("position", F.row_number().over(W.partitionBy("doc").orderBy(F.desc(is_low), "score", "sentence_id")))


def summary(sentences: DataFrame, issues: DataFrame, aligned: DataFrame, low: float = 0.35) -> DataFrame:
    """(doc, sentence_total, sentence_scored, low_alignment_sentences, style_issue_sentences, issue_counts)."""
    all_ = issues.select(*_SHAPE).unionByName(low_alignment(aligned, low))
    total = sentences.groupBy("doc").agg(F.count(F.lit(1)).alias("sentence_total"))
    scored = aligned.groupBy("doc").agg(F.count(F.lit(1)).alias("sentence_scored"), F.count_if(F.col("score") < low).alias("low_alignment_sentences"))
    styled = all_.where(F.col("issue_type").isin(*STYLE_TYPES)).select("doc", "sentence_id").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("style_issue_sentences"))
    counts = all_.groupBy("doc", "issue_type").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("issue_type", "n")))).alias("issue_counts"))
    out = total.join(scored, "doc", "left").join(styled, "doc", "left").join(counts, "doc", "left")
    return out.fillna(0, ["sentence_scored", "low_alignment_sentences", "style_issue_sentences"])


def lexical(sentences: DataFrame, vocabulary: DataFrame, docs: DataFrame, top: int = 20, first: int = 400, keep: int = 30) -> DataFrame:
    """(doc, lang, kind, token, n, doc_freq, ratio, position): the most frequent words of each paper, and those of them the library hardly has.

    ``docs``: (lang, docs) documents of the library by language; a mixed sentence counts in both languages.
    """
    en = sentences.where(F.col("lang") != "zh").select("doc", F.lit("en").alias("lang"), F.explode(T.words(F.col("text"))).alias("token"))
    zh = sentences.where(F.col("lang") != "en").select("doc", F.lit("zh").alias("lang"), F.explode(T.han_words(F.col("text"))).alias("token"))
    n = en.unionByName(zh).groupBy("doc", "lang", "token").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("position", F.row_number().over(W.partitionBy("doc", "lang").orderBy(F.desc("n"), "token"))).where(F.col("position") <= first)
    j = n.join(vocabulary.select("token", "doc_freq"), "token", "left").join(F.broadcast(docs), "lang", "left")  # two rows
    j = j.withColumn("doc_freq", F.coalesce("doc_freq", F.lit(0))).withColumn("ratio", F.col("doc_freq") / F.greatest(F.coalesce("docs", F.lit(1)), F.lit(1)))
    shape = ["doc", "lang", "kind", "token", "n", "doc_freq", "ratio", "position"]
    often = j.where(F.col("position") <= top).withColumn("kind", F.lit("top"))
    enough = F.when(F.col("lang") == "zh", 5).otherwise(8)
    rare = j.where((F.col("n") >= enough) & ((F.col("doc_freq") <= 1) | (F.col("ratio") <= 0.02)))
    rare = rare.withColumn("position", F.row_number().over(W.partitionBy("doc", "lang").orderBy("position"))).where(F.col("position") <= keep).withColumn("kind", F.lit("rare"))
    return often.select(*shape).unionByName(rare.select(*shape))
