"""A small English language model, written for this library: it stands in for a lexicon that users bring."""

from __future__ import annotations

NORMALS = {"n't": "not", "'ll": "will", "'ve": "have", "'re": "are", "'m": "am", "'d": "would"}
STOP_WORDS = tuple(
    "a an the and or but if of at by for with about to from in on off over under again then here there all any both each few more most other some such no nor not only own same so than too very is are was were be been being have has had do does did this that these those it its as what which who whom i you he she we they".split()
)
CUES = ("not", "n't", "no", "never", "neither", "nor", "without", "cannot")
TERMINATORS = ("but", ",", ";", ":", "however", "although", "and")
#: Word scores in thousandths.
SENTIMENT = {"good": 500, "great": 700, "excellent": 800, "love": 700, "like": 300, "happy": 600, "best": 700, "bad": -500, "worthless": -600, "trash": -600, "disgusting": -800, "stupid": -600, "pathetic": -600, "terrible": -800, "hate": -800, "worst": -800, "scum": -700, "idiot": -700, "clown": -300}
#: Closed-class words by part of speech; other words are guessed.
POS = {
    "DET": "a an the this that these those each every some any no".split(),
    "ADP": "of in on at by for with from to over under about as off".split(),
    "CCONJ": "and or but nor".split(),
    "SCONJ": "if because while although".split(),
    "PRON": "i you he she it we they who what which its".split(),
    "AUX": "is are was were be been being am have has had do does did will would can could may might should must".split(),
    "PART": "not n't".split(),
    "ADV": "here there then again very too only so never".split(),
    "ADJ": "good bad great best worst other same such own few more most".split(),
}
# fixed values: what the end, else the beginning of an unknown word in small letters tells of it; the longest counts
SUFFIX_POS = {
    "ing": "VERB", "ed": "VERB", "ly": "ADV", "able": "ADJ", "tish": "ADJ", "like": "ADJ", "ous": "ADJ", "ful": "ADJ", "ary": "ADJ", "less": "ADJ", "ier": "ADJ", "est": "ADJ", "fy": "ADJ", "ky": "ADJ",
    "es": "NOUN", "er": "NOUN", "or": "NOUN", "ity": "NOUN", "ion": "NOUN", "llah": "PROPN", "stan": "PROPN", "gton": "PROPN", "abad": "PROPN", "land": "PROPN", "pur": "PROPN", "tnam": "PROPN",
}
PREFIX_POS = {"anti": "ADJ", "post": "ADJ", "non": "ADJ", "cross": "NOUN"}
OPEN_CLASSES = ("ADJ", "ADV", "INTJ", "NOUN", "PROPN", "VERB", "NUM", "SYM")
TYPE_POS = {"number": "NUM", "decade": "NUM", "punctuation": "PUNCT", "url": "SYM", "email": "SYM", "hashtag": "SYM", "emoji": "SYM", "emoticon": "SYM", "time": "SYM", "symbol": "SYM", "mention": "PROPN", "ordinal": "ADJ", "tabCRLF": "SPACE"}
IRREGULAR = {"was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "am": "be", "has": "have", "had": "have", "did": "do", "does": "do", "men": "man", "women": "woman", "children": "child", "better": "good", "best": "good", "worse": "bad", "worst": "bad", "ate": "eat", "went": "go"}
#: Suffix rules in order: pattern of the whole word, and how many letters go, what comes.
LEMMA_RULES = (("[^aeiou]ies$", 3, "y"), ("(?:ch|sh|ss|x|z)es$", 2, ""), ("[^su]s$", 1, ""), ("[a-z]{3,}ing$", 3, ""), ("[a-z]{3,}ed$", 2, ""))
# fixed values: by part of speech, endings in the order they are tried, and what takes their place
ENDINGS = {
    "ADJ": (("est|er", ""), ("est|er", "e")),
    "VERB": (("s", ""), ("ies", "y"), ("es|ed|ing", ""), ("es|ed|ing", "e")),
    "NOUN": (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "s"), ("ves", "f"), ("ches", "ch"), ("shes", "sh"), ("ies", "y")),
}
ENTITIES = ("email", "url", "mention", "hashtag", "emoji", "emoticon", "time", "ordinal", "number", "decade")
ENTITY_NAMES = {"number": "CARDINAL", "decade": "DATE"}
# fixed values: syllables of words that the rules get wrong
SYLLABLES = {
    "adobe": 3, "anemone": 4, "anyone": 3, "apache": 3, "aphrodite": 4, "apostrophe": 4, "ariadne": 4, "chummed": 1, "cafe": 2, "calliope": 4, "catastrophe": 4, "chile": 2, "chloe": 2, "circe": 2,
    "coyote": 3, "daphne": 2, "epitome": 4, "eurydice": 4, "euterpe": 3, "every": 2, "everywhere": 3, "forever": 3, "gethsemane": 4, "guacamole": 4, "hermione": 4, "hyperbole": 4, "jesse": 2, "jukebox": 2,
    "karate": 3, "peeped": 1, "moustaches": 2, "shamefully": 3, "messieurs": 2, "satiated": 4, "sailmaker": 4, "sheered": 1, "disinterred": 3, "propitiatory": 6, "bepatched": 2, "particularized": 5, "caressed": 2,
    "trespassed": 2, "sepulchre": 3, "flapped": 1, "hemispheres": 3, "pencilled": 2, "motioned": 2, "machete": 3, "maybe": 2, "naive": 2, "newlywed": 3, "penelope": 4, "people": 2, "persephone": 4, "phoebe": 2,
    "pulse": 1, "queue": 1, "recipe": 3, "riverbed": 3, "sesame": 3, "shoreline": 2, "simile": 3, "snuffleupagus": 5, "sometimes": 2, "syncope": 3, "poleman": 2, "slandered": 2, "sombre": 2, "etc": 4,
    "sidespring": 2, "mimes": 1, "effaces": 2, "mr": 2, "mrs": 2, "ms": 1, "dr": 2, "st": 1, "sr": 2, "jr": 2, "truckle": 2, "foamed": 1, "fringed": 2, "clattered": 2, "capered": 2, "mangroves": 2, "suavely": 2,
    "reclined": 2, "brutes": 1, "effaced": 2, "quivered": 2, "veriest": 3, "sententiously": 4, "deafened": 2, "manoeuvred": 3, "unstained": 2, "gaped": 1, "stammered": 2, "shivered": 2, "discoloured": 3,
    "gravesend": 2, "lb": 1, "unexpressed": 3, "greyish": 2, "unostentatious": 5, "tamale": 3, "waterbed": 3, "wednesday": 2, "yosemite": 4,
}
# fixed values: patterns that have a syllable more, and one less, than their groups of vowels; a silent end goes first
SILENT_END = "e$"
MORE_SYLLABLES = (
    "ia", "riet", "dien", "iu", "io", "ii", "[aeiouy]bl$", "mbl$", "[aeiou]{3}", "^mc", "ism$", "[^l]llien", "^coad.", "^coag.", "^coal.", "^coax.", ".[gq]ua.[aeiou]", "dnt$", "eings?$", "react?$",
    "[aeiouy]sh?e[rs]$", "(?:eo|asm|dea|gean|oa|ua|uity|thm|ism|orbed|shred)$",
)
FEWER_SYLLABLES = (
    "cial", "tia", "cius", "cious", "gui", "ion", "iou", "sia$", ".ely$", ".[^aeiuoycgltdb]{2,}ed$", "(?:s[chkls]|g[hn])ed$",
    "(?:[aeiouy](?:[bdfklmnprstvy]|ch|dg|g[hn]|lch|s[cklst]))es$", "(?:[aeiouy](?:[bcfgklmnprsvwxyz]|s[chkls]))ed$",
)

#: Rules that rewrite default tags, in order: tag, new tag, the tag before, the tag after (None: any).
POS_RULES = (
    ("VERB", "ADJ", "DET", "NOUN"),
    ("VERB", "NOUN", "DET", None),
    ("NOUN", "VERB", "PRON", None),
    ("NOUN", "VERB", "PART", "DET"),
    ("ADJ", "NOUN", "DET", "VERB"),
    ("ADJ", "NOUN", "DET", "PUNCT"),
    ("DET", "PRON", None, "VERB"),
    ("DET", "PRON", None, "AUX"),
)
#: What a lower-cased token may be in an entity of several tokens: a letter and the pattern that gives it, the first one that fits.
HINTS = (
    ("d", r"^(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.\-]\d{1,2}[/.\-](?:\d{4}|\d{2}))$"),
    ("y", r"^(?:1[2-9]\d\d|20\d\d|2100)$"),
    ("n", r"^\d+(?:[.,]\d+)*$"),
    ("o", r"^\d+(?:st|nd|rd|th)$"),
    ("t", r"^\d{1,2}(?::\d{2})(?:am|pm)?$|^\d{1,2}(?:am|pm)$"),
    ("c", r"^[$€£¥]$"),
    ("w", r"^(?:dollars?|euros?|pounds?|cents?)$"),
    ("p", r"^(?:%|percent)$"),
    ("u", r"^(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)$"),
    ("m", r"^(?:january|february|march|april|may|june|july|august|september|october|november|december)$"),
    ("v", r"^,$"),
    ("D", r"^'\d0s$"),
)
#: Entities by the letters of their tokens; longer ways stand first.
PHRASES = (("MONEY", "c[ny]|[ny]w"), ("PERCENT", "[ny]p"), ("DURATION", "[ny]u"), ("DATE", "m[no]vy|m[no]y|[no]my|m[noy]|[no]m|d|D"), ("TIME", "t"), ("ORDINAL", "o"), ("CARDINAL", "[ny]"))


def phrase_pattern() -> str:
    """An ordered alternation over tokens written as letter, U+0001, value, U+0002: entities, the longer first, else one token."""
    import re

    ways = sorted((way for _, own in PHRASES for way in own.split("|")), key=lambda w: -len(re.findall(r"\[.*?\]|.", w)))
    token = lambda letter: f"{letter}\x01[^\x02]*\x02"
    return "|".join("".join(token(x) for x in re.findall(r"\[.*?\]|.", way)) for way in ways) + "|" + token("[a-zA-Z]")
