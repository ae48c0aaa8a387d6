"""Annotators: documents -> tokens -> sentences, negation, sentiment, parts of speech, entities.

``annotated`` and what builds on it work inside each document's row: its tokens become one string with signs between,
sentences and the reach of negations are found by splitting that string, and only then are tokens exploded, so that
nothing is shuffled to put them in order. ``sentences`` and ``negation`` do the same over a table of tokens that is
at hand, by windows over one document or sentence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions import text as T


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("idx")


def by_sentence() -> WindowSpec:
    return Window.partitionBy("doc_id", "sent_idx").orderBy("idx")


def tokenize(df: DataFrame, text: str = "text", key: str = "doc_id", *carry: str) -> DataFrame:
    """(doc_id, idx, value) and carried columns; idx counts from 0. A null or blank text has no tokens."""
    return df.select(F.col(key).alias("doc_id"), *carry, F.posexplode(T.tokens(F.col(text))).alias("idx", "value"))


def tokenize_spaced(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, idx, value, spaces): tokens with the white space before them."""
    return df.select(F.col(key).alias("doc_id"), F.posexplode(T.spaced_tokens(F.col(text))).alias("idx", "t")).select("doc_id", "idx", "t.value", "t.spaces")


def lower(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("normal", F.lower("value"))


def typed(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("type", T.type_of(F.col("value")))


def words(tokens: DataFrame) -> DataFrame:
    """Tokens with a letter, lower-cased as term."""
    return tokens.filter(F.col("value").rlike(r"[\p{L}]")).withColumn("term", F.lower("value"))


def sentences(tokens: DataFrame) -> DataFrame:
    """With sent_idx: a sentence ends after . ! or ? and after a line end; what floats at the end is one more."""
    ends = F.col("value").isin(".", "!", "?") | F.col("value").rlike(r"^[\n\r\t]+$")
    before = F.lag(F.when(ends, 1).otherwise(0), 1, 0).over(by_doc())
    return tokens.withColumn("_new", before).withColumn("sent_idx", F.sum("_new").over(by_doc())).drop("_new")


def negation(sentenced: DataFrame) -> DataFrame:
    """With negated: a token after a cue, and before the next terminator or the end of the sentence, without signs."""
    low = F.lower("value")
    mark = F.when(low.isin(*L.CUES), 1).when(low.isin(*L.TERMINATORS), 0)
    last = F.last(mark, ignorenulls=True).over(by_sentence().rowsBetween(Window.unboundedPreceding, -1))
    return sentenced.withColumn("negated", (F.coalesce(last, F.lit(0)) == 1) & mark.isNull() & F.col("value").rlike(r"[\p{L}\p{N}]"))


#: Signs between tokens, before a token's value, before one that a negation reaches, and where a string is to be split:
#: after sentences, around terminators and after cues. They are no characters of any text.
SEP, OWN, REACHED, END, TURN, CUE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4", "\ufdd5"
_ENDS = f"([{OWN}{REACHED}][.!?]{SEP}|[\n\r\t]{SEP})"
_TURNS = rf"(\d*+{OWN}(?i:{'|'.join(map(re.escape, L.TERMINATORS))}){SEP})"
_CUES = f"({OWN}(?i:{'|'.join(map(re.escape, L.CUES))}){SEP})"


def _is_end(token: Column) -> Column:
    """Whether a token ends a sentence; one that begins with a line end or a tab holds nothing else."""
    return F.ascii(token).isin(9, 10, 13) | token.isin(".", "!", "?")


def _own(text: Column) -> Column:
    return T.tokens(F.translate(text, SEP + OWN + REACHED + END + TURN + CUE, "      "))


def _string(text: Column, numbered: bool) -> Column:
    """A text's tokens as one string: each its number, if wanted, OWN, its value and SEP."""

    def named(own: Column) -> Column:
        if numbered:
            out = F.concat(F.array_join(F.transform(own, lambda t, i: F.concat(i.cast("string"), F.lit(OWN), t)), SEP), F.lit(SEP))
        else:
            out = F.concat(F.lit(OWN), F.array_join(own, SEP + OWN), F.lit(SEP))
        return F.when(F.size(own) > 0, out).otherwise("")

    return T.let(_own(text), named)


def _reached(string: Column) -> Column:
    """The string with REACHED for OWN after each cue, up to the next terminator or the end of the sentence."""

    def marked(string: Column) -> Column:
        turns = F.regexp_replace(F.regexp_replace(string, _TURNS, f"{TURN}$1"), _ENDS, f"$1{TURN}")
        parts = F.transform(F.split(F.regexp_replace(turns, _CUES, f"$1{CUE}"), TURN), lambda x: F.split(x, CUE, 2))
        out = F.array_join(F.transform(parts, lambda p: F.concat(F.get(p, F.lit(0)), F.coalesce(F.translate(F.get(p, F.lit(1)), OWN + CUE, REACHED), F.lit("")))), "")
        return F.when(string.rlike(_CUES), out).otherwise(string)

    return T.let(string, marked)


def _pieces(string: Column) -> Column:
    """The sentences of a string, each with its tokens' signs."""
    return F.array_remove(F.split(F.regexp_replace(string, _ENDS, f"$1{END}"), END), "")


def n_sentences(text: Column) -> Column:
    """One for each token that ends a sentence, and one for what follows the last; null without tokens."""

    def counted(own: Column) -> Column:
        after = F.when(_is_end(F.element_at(own, -1)), 0).otherwise(1)
        return F.when(F.size(own) > 0, F.size(F.filter(own, _is_end)) + after).cast("long")

    return T.let(_own(text), counted)


def annotated(df: DataFrame, *carry: str, text: str = "text", key: str = "doc_id", numbered: bool = True, negated: bool = True) -> DataFrame:
    """(doc_id, carried columns, sent_idx, idx, value, negated), a row a token, without a shuffle; idx if numbered.

    Sentences and negation are those of ``sentences`` and ``negation``. The noncharacters U+FDD0 to U+FDD5 count as
    spaces. A null or blank text has no rows; a doc_id may repeat.
    """
    string = _string(F.col(text), numbered)
    pieces = df.select(F.col(key).alias("doc_id"), *carry, F.posexplode(_pieces(_reached(string) if negated else string)).alias("sent_idx", "piece"))
    rows = pieces.select("doc_id", *carry, F.col("sent_idx").cast("long").alias("sent_idx"), F.explode(F.array_remove(F.split("piece", SEP), "")).alias("t"))
    plain = F.translate("t", REACHED, OWN) if negated else F.col("t")
    value = F.split_part(plain, F.lit(OWN), F.lit(2)).alias("value")
    idx = [F.split_part(plain, F.lit(OWN), F.lit(1)).cast("int").alias("idx")] if numbered else []
    if not negated:
        return rows.select("doc_id", *carry, "sent_idx", *idx, value)
    rows = rows.select("doc_id", *carry, "sent_idx", *idx, value, F.contains("t", F.lit(REACHED)).alias("reached"))
    return rows.withColumn("negated", F.col("reached") & ~F.lower("value").isin(*L.CUES) & F.col("value").rlike(r"[\p{L}\p{N}]")).drop("reached")


def sentence_spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, sent_idx, first, last, text): each sentence's tokens, joined by a space, and where they lie."""
    rows = df.select(F.col(key).alias("doc_id"), F.posexplode(_pieces(_string(F.col(text), True))).alias("sent_idx", "piece"))
    first = F.split_part("piece", F.lit(OWN), F.lit(1)).cast("long")
    words = F.regexp_replace("piece", rf"\d*+{OWN}", "")
    shown = F.translate(F.substring(words, 1, F.length(words) - 1), SEP, " ")
    return rows.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), first.alias("first"), (first + F.regexp_count("piece", F.lit(SEP)) - 1).alias("last"), shown.alias("text"))


def score_of(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in L.SENTIMENT.items() for x in kv])
    low = F.lower(token)
    return F.when(low.isin(*L.SENTIMENT), F.try_element_at(table, low)).cast("double") / 1000


def sentence_sentiment(negated: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, sentiment): the mean score of scored words, a negated one's with its sign turned; else 0."""
    score = score_of(F.col("value"))
    signed = F.when(F.col("negated"), -score).otherwise(score)
    return negated.groupBy("doc_id", "sent_idx").agg(F.coalesce(F.sum(signed) / F.nullif(F.count(score), F.lit(0)), F.lit(0.0)).alias("sentiment"))


def document_sentiment(negated: DataFrame) -> DataFrame:
    return sentence_sentiment(negated).groupBy("doc_id").agg((F.sum("sentiment") / F.count(F.lit(1))).alias("sentiment"))


#: A letter for each part of speech.
TAGS = {tag: chr(65 + i) for i, tag in enumerate(sorted({*L.POS, *L.TYPE_POS.values(), *L.OPEN_CLASSES}))}


SMALL = r"^[a-z][a-z\-–—.]*$"
_ENDINGS = f"(?:{'|'.join(L.SUFFIX_POS)})$"
_BEGINNINGS = f"^(?:{'|'.join(L.PREFIX_POS)})"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _unknown_pos(word: Column, say: dict[str, str]) -> Column:
    named = lambda table: _table({x: say[t] for x, t in table.items()})
    ending = F.try_element_at(named(L.SUFFIX_POS), F.regexp_extract(word, _ENDINGS, 0))
    beginning = F.try_element_at(named(L.PREFIX_POS), F.regexp_extract(word, _BEGINNINGS, 0))
    return F.when(word.rlike(SMALL), F.coalesce(ending, beginning, F.lit(say["NOUN"]))).otherwise(say["PROPN"])


def unknown_pos(word: Column) -> Column:
    """The tag of a word that no list has: a name unless in small letters, else by its ending or beginning."""
    return _unknown_pos(word, {t: t for t in TAGS})


def pos_of(token: Column, say: dict[str, str] | None = None) -> Column:
    """Default tag, or what ``say`` has for it: closed-class words by list, signs by type, other words as unknown_pos."""
    say = say or {t: t for t in TAGS}
    kind = T.type_of(token)
    guess = _unknown_pos(token, say)
    signs = F.when(kind == "word", guess).when(token.rlike("^[A-Z]"), say["PROPN"]).otherwise(say["NOUN"])
    for name, tag in L.TYPE_POS.items():
        signs = F.when(kind == name, say[tag]).otherwise(signs)
    closed = {w: say[tag] for tag, own in reversed(L.POS.items()) for w in own}
    # letters alone are a word; a list's words are looked for once
    plain = F.when(F.lower(token).isin(*closed), F.element_at(_table(closed), F.lower(token)))
    return F.coalesce(plain, F.when(token.rlike(r"^\p{L}+$"), guess).when(token.isin(*".,!?-()'\""), say[L.TYPE_POS["punctuation"]]).otherwise(signs))


def contextual_pos(sentenced: DataFrame) -> DataFrame:
    """With pos: default tags, rewritten by the lexicon's rules in order, each over its sentence as the last one left it.

    All passes share one partitioning and order, so that they need one exchange.
    """
    rows = sentenced.withColumn("pos", pos_of(F.col("value")))
    for tag, to, before, after in L.POS_RULES:
        fits = F.col("pos") == tag
        if before:
            fits &= F.coalesce(F.lag("pos").over(by_sentence()), F.lit("")) == before
        if after:
            fits &= F.coalesce(F.lead("pos").over(by_sentence()), F.lit("")) == after
        rows = rows.withColumn("pos", F.when(fits, to).otherwise(F.col("pos")))
    return rows


def tag_string(text: Column, contextual: bool = False) -> Column:
    """The tags of a text's tokens as letters of TAGS, with a line end after each sentence; contextual_pos's if wanted."""
    out = F.array_join(F.transform(T.tokens(text), lambda t: F.concat(pos_of(t, TAGS), F.when(_is_end(t), "\n").otherwise(""))), "")
    for tag, to, before, after in L.POS_RULES if contextual else ():
        out = F.regexp_replace(out, (f"(?<={TAGS[before]})" if before else "") + TAGS[tag] + (f"(?={TAGS[after]})" if after else ""), TAGS[to])
    return out


def hint_of(token: Column) -> Column:
    """One letter for what a token may be in an entity."""
    low = F.lower(token)
    out = F.lit("x")
    for letter, pattern in reversed(L.HINTS):
        out = F.when(low.rlike(pattern), letter).otherwise(out)
    return out


def phrase_entities(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, first, last, value, entity): the leftmost and longest runs of tokens whose hints make an entity.

    Each token is written as its hint, a sign, its value and another sign; one ordered alternation cuts a text's tokens
    into entities and other tokens, and a running sum gives positions. U+0001 and U+0002 in a text count as spaces.
    """
    own = F.transform(T.tokens(F.translate(F.col(text), "\x01\x02", "  ")), lambda t: F.concat(hint_of(t), F.lit("\x01"), t, F.lit("\x02")))
    pieces = F.regexp_extract_all(F.array_join(own, ""), F.lit(L.phrase_pattern()), F.lit(0))
    rows = df.select(F.col(key).alias("doc_id"), F.posexplode(pieces).alias("idx", "piece")).withColumn("n", F.regexp_count("piece", F.lit("\x02")))
    until = F.sum("n").over(by_doc())
    shape = F.regexp_replace("piece", "\x01[^\x02]*\x02", "")
    entity = F.lit(None).cast("string")
    for name, ways in reversed(L.PHRASES):
        entity = F.when(shape.rlike(f"^(?:{ways})$"), name).otherwise(entity)
    found = rows.withColumn("last", until - 1).withColumn("entity", entity).filter("entity is not null")
    value = F.array_join(F.regexp_extract_all("piece", F.lit("\x01([^\x02]*)\x02"), F.lit(1)), " ")
    return found.select("doc_id", (F.col("last") - F.col("n") + 1).alias("first"), "last", value.alias("value"), "entity")


def lemma_of(token: Column) -> Column:
    low = F.lower(token)
    out = low
    for pattern, gone, come in reversed(L.LEMMA_RULES):
        out = F.when(low.rlike(pattern), F.concat(F.substring(low, 1, F.length(low) - gone), F.lit(come))).otherwise(out)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.IRREGULAR.items() for x in kv]), low), out)


def entities(tokens: DataFrame) -> DataFrame:
    """(doc_id, idx, value, entity) of tokens whose type is an entity by itself."""
    kinds = typed(tokens).filter(F.col("type").isin(*L.ENTITIES))
    named = F.upper("type")
    for kind, name in L.ENTITY_NAMES.items():
        named = F.when(F.col("type") == kind, name).otherwise(named)
    return kinds.withColumn("entity", named).drop("type")


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), L.SILENT_END, "")


def syllables_of(word: Column, bare: Column | None = None) -> Column:
    """Syllables: by list, else groups of vowels without a silent end, more or fewer by patterns, but at least one.

    ``bare`` is the word as _bare makes it, if it is at hand.
    """
    low, bare = F.lower(word), _bare(word) if bare is None else bare
    groups = F.regexp_count(bare, F.lit("[aeiouy]+"))
    count = groups
    for pattern in L.MORE_SYLLABLES:
        count += bare.rlike(pattern).cast("int")
    for pattern in L.FEWER_SYLLABLES:
        count -= bare.rlike(pattern).cast("int")
    # most words fit none of the patterns
    count = F.when(bare.rlike("|".join((*L.MORE_SYLLABLES, *L.FEWER_SYLLABLES))), F.greatest(count, F.lit(1))).otherwise(F.greatest(groups, F.lit(1)))
    table = F.create_map(*[F.lit(x) for kv in L.SYLLABLES.items() for x in kv])
    return F.when(F.length(low) < 3, 1).when(low.isin(*L.SYLLABLES), F.element_at(table, low)).otherwise(count)


def readability(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_sentences, n_syllables, n_complex, fres): Flesch's ease, of documents with a word."""
    counted = df.select("doc_id", n_sentences(F.col("text")).alias("n_sentences"), T.tokens(F.col("text")).alias("values"))
    rows = counted.select("doc_id", "n_sentences", F.explode("values").alias("value"))
    rows = rows.filter(F.col("value").rlike(r"^[\p{L}]")).withColumn("bare", _bare(F.col("value"))).withColumn("syllables", syllables_of(F.col("value"), F.col("bare")))
    out = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.max("n_sentences").alias("n_sentences"),
        F.sum("syllables").cast("long").alias("n_syllables"),
        F.count_if(F.col("syllables") > 3).alias("n_complex"),
    )
    ease = F.lit(206.835) - F.lit(1.015) * (F.col("n_words") / F.col("n_sentences")) - F.lit(84.6) * (F.col("n_syllables") / F.col("n_words"))
    return out.withColumn("fres", F.floor(ease.cast("double") + 0.5).cast("long"))


def reading_time(stats: DataFrame) -> DataFrame:
    """readability's rows with minutes and seconds: easier texts are read faster, from 200 words a minute on."""
    ease = F.lit(206.835).cast("double") - F.lit(1.015).cast("double") * (F.col("n_words") / F.col("n_sentences")) - F.lit(84.6).cast("double") * (F.col("n_syllables") / F.col("n_words"))
    t = F.col("n_words") / (F.lit(200.0) + ease)
    return stats.withColumn("mins", F.floor(t).cast("long")).withColumn("secs", F.floor((t - F.floor(t)) * 60 + 0.5).cast("long"))


def complex_words(df: DataFrame) -> DataFrame:
    """(doc_id, term, extra): distinct words of more than three syllables, and by how many they exceed three."""
    rows = tokenize(df).filter(F.col("value").rlike(r"^[\p{L}]")).select("doc_id", F.lower("value").alias("term")).distinct()
    return rows.withColumn("extra", (syllables_of(F.col("term")) - 3).cast("long")).filter("extra > 0")


def sentence_importance(df: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, importance): by how often a sentence's runs of four tags occur in its document.

    Spaces and punctuation are left out; a run weighs its count less its closed-class tags; weights of at most 0
    count nothing; the greatest sum of a document is 1. Sentences of fewer than four tags are left out. One letter a
    token is dealt out by doc_id; all that follows stays where it is.
    """
    letters = F.translate(tag_string(F.col("text")), TAGS["SPACE"] + TAGS["PUNCT"], "")
    dealt = df.select("doc_id", letters.alias("tags")).repartition("doc_id")
    rows = dealt.select("doc_id", F.posexplode(F.split("tags", "\n")).alias("sent_idx", "tags")).filter(F.length("tags") > 3)
    runs = rows.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "tags", F.explode(F.sequence(F.lit(1), F.length("tags") - 3)).alias("at"))
    runs = runs.select("doc_id", "sent_idx", F.substr("tags", F.col("at"), F.lit(4)).alias("run"))
    counts = runs.groupBy("doc_id", "run", "sent_idx").agg(F.count(F.lit(1)).alias("n"))
    closed = F.length(F.regexp_replace("run", f"[{''.join(TAGS[x] for x in L.OPEN_CLASSES)}]", ""))
    weighed = counts.withColumn("w", F.col("n") * F.greatest(F.sum("n").over(Window.partitionBy("doc_id", "run")) - closed, F.lit(0)))
    sums = weighed.groupBy("doc_id", "sent_idx").agg(F.sum("w").alias("w"))
    most = F.max("w").over(Window.partitionBy("doc_id"))
    return sums.select("doc_id", "sent_idx", F.round(F.col("w") / F.when(most == 0, 1).otherwise(most), 4).alias("importance"))


def marked_up(df: DataFrame, begin: str = "<mark>", end: str = "</mark>") -> DataFrame:
    """(doc_id, marked): tokens joined by a space, entities between marks."""
    rows = typed(tokenize(df))
    shown = F.when(F.col("type").isin(*L.ENTITIES), F.concat(F.lit(begin), "value", F.lit(end))).otherwise(F.col("value"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", shown.alias("shown"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), " ").alias("marked"))


# white space beyond the space, as it is trimmed
BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
OUTER = f"^{BLANK}+|{BLANK}+$"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends; ``$`` is the very end."""
    return F.regexp_replace(text, OUTER.replace("$", r"\z"), "")


def detokenize(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) from tokens and the spaces before them: the text without outer white space. Null: null."""
    spaced = F.regexp_extract_all(F.col(text), F.lit(rf"([\s\x{{A0}}\x{{2002}}-\x{{2005}}\x{{2009}}\x{{200A}}\x{{202F}}\x{{205F}}]*?)({T.PATTERN})"), F.lit(0))
    return df.select(F.col(key).alias("doc_id"), trimmed(F.array_join(spaced, "")).alias("text"))


def lemmas(tokens: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(value, pos, lemma) of the distinct (value, pos) of tokens, by tables that a user brings: lexicon (word, pos) of
    known words, exceptions (word, pos, lemma).

    An exception's lemma comes first; else the candidates of the part of speech are tried in order, and the first
    that the lexicon has with that tag is taken; other words are their own lemma, but nouns in -men end in -man.
    Values are compared in lower case. Each table is joined by word and tag, however large it is.
    """
    rows = tokens.select(F.lower("value").alias("value"), "pos").distinct()
    if exceptions is not None:
        rows = rows.join(exceptions.select(F.col("word").alias("value"), "pos", F.col("lemma").alias("_known")).dropDuplicates(["value", "pos"]), ["value", "pos"], "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))

    def ways(rules) -> Column:
        tried = [F.when(F.col("value").rlike(f"(?:{end})$"), F.concat(F.regexp_replace("value", f"(?:{end})$", ""), F.lit(come))) for end, come in rules]
        return F.filter(F.array(*tried), lambda x: x.isNotNull())

    candidates = F.lit(None).cast("array<string>")
    for pos, rules in L.ENDINGS.items():
        candidates = F.when(F.col("pos") == pos, ways(rules)).otherwise(candidates)
    tried = rows.select("value", "pos", "_known", F.posexplode_outer(candidates).alias("rank", "way"))
    words = lexicon.select(F.col("word").alias("way"), "pos", F.lit(True).alias("_has")).dropDuplicates(["way", "pos"])
    found = tried.join(words, ["way", "pos"], "left").groupBy("value", "pos").agg(F.first("_known").alias("_known"), F.min_by("way", F.when(F.col("_has"), F.col("rank"))).alias("way"), F.max("_has").alias("_has"))
    rest = F.when(F.col("pos") == "NOUN", F.regexp_replace("value", "men$", "man")).otherwise(F.col("value"))
    return found.select("value", "pos", F.coalesce("_known", F.when(F.col("_has"), F.col("way")), rest).alias("lemma"))
