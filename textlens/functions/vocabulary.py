"""Word lists, classes and presentation roles."""

from __future__ import annotations

# Closed-class words by kind.
CLOSED = {
    "Article": ["a", "an", "the"],
    "Determiner": ["this", "that", "these", "those", "each", "every", "either", "neither", "all", "any", "some", "no", "both", "few", "more", "most", "much", "many", "several", "such", "another", "enough", "less", "little", "same", "what", "which", "whose", "whatever", "whichever", "my", "your", "his", "her", "its", "our", "their"],
    "Pronoun": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "us", "them", "mine", "yours", "hers", "ours", "theirs", "myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves", "themselves", "who", "whom", "whoever", "whomever", "someone", "somebody", "something", "anyone", "anybody", "anything", "everyone", "everybody", "everything", "nobody", "nothing", "none", "one", "oneself", "i'm", "you're", "we're", "they're", "he's", "she's", "it's", "that's", "there's", "who's", "i've", "you've", "we've", "they've", "i'll", "you'll", "we'll", "they'll", "he'll", "she'll", "it'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd"],
    "Preposition": ["of", "in", "on", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "above", "below", "to", "from", "up", "down", "over", "under", "out", "off", "near", "within", "without", "upon", "onto", "toward", "towards", "among", "across", "behind", "beyond", "beside", "besides", "despite", "except", "inside", "outside", "per", "since", "till", "until", "unto", "via", "amid", "around", "atop", "before", "after", "underneath", "throughout", "regarding", "concerning"],
    "Conjunction": ["and", "but", "or", "nor", "so", "yet", "because", "although", "though", "while", "whereas", "if", "unless", "whether", "as", "lest", "whilst", "once", "when", "whenever", "where", "wherever", "than"],
    "Auxiliary": ["be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "done", "will", "would", "shall", "should", "can", "could", "may", "might", "must", "ought", "need", "dare", "used", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "won't", "wouldn't", "can't", "cannot", "couldn't", "shouldn't", "mustn't", "mightn't", "shan't", "needn't", "ain't"],
    "Negator": ["not", "never"],
}
# Open-class seed words by kind.
OPEN = {
    "Noun": ["cat", "dog", "mountain", "river"],
    "Verb": ["connects", "glows", "renders", "writes"],
    "Adjective": ["careful", "quick", "silent", "structural"],
    "Adverb": ["carefully", "quickly", "silently", "slowly"],
}
# Words whose class the neighbours decide.
AMBIGUOUS = ["book", "record", "lead", "fast"]
# Fixed values of the prose rules.
WEAK_WORDS = ["very", "really", "just", "actually", "quite", "basically", "literally", "simply", "totally", "definitely"]
BE_AUXILIARIES = ["is", "are", "was", "were", "be", "been", "being", "am"]
EVENTIVE = ["cleaned", "reviewed", "written"]
NEEDS_BY_PHRASE = ["broken", "closed", "known", "lost"]
NO_AGENT = ["now", "then"]
QUOTES = ['"', "'", "“", "”", "‘", "’", "«", "»"]
CLOSERS = [*QUOTES, ")", "]", "}"]
# Role, ANSI code, editor token type, highlight class, in legend order.
ROLES = [
    ("STRUCTURAL_KEYWORD", "1;35", "keyword", "keyword"),
    ("TYPE_LIKE", "1;33", "class", "type"),
    ("LITERAL", "36", "number", "number"),
    ("QUOTED", "32", "string", "string"),
    ("MUTED", "90", None, None),
    ("UNSTYLED", None, None, None),
    ("NOUN", "34", "noun", "noun"),
    ("VERB", "31", "verb", "verb"),
    ("ADJECTIVE", "33", "adjective", "adjective"),
    ("ADVERB", "35", "adverb", "adverb"),
]
# Token kind, lexical class, open class and the role they have together.
AXES = [
    ("WORD", "FUNCTION", None, "STRUCTURAL_KEYWORD"),
    ("WORD", "PROPER_NOUN_CANDIDATE", None, "TYPE_LIKE"),
    ("WORD", "CONTENT", None, "UNSTYLED"),
    ("WORD", "CONTENT", "NOUN", "NOUN"),
    ("WORD", "CONTENT", "VERB", "VERB"),
    ("WORD", "CONTENT", "ADJECTIVE", "ADJECTIVE"),
    ("WORD", "CONTENT", "ADVERB", "ADVERB"),
    ("NUMBER", None, None, "LITERAL"),
    ("PUNCTUATION", None, None, "MUTED"),
    ("QUOTE", None, None, "QUOTED"),
]
LEGEND = [t for _, _, t, _ in ROLES if t]

#: (word, kind) rows
CLOSED_ROWS = [(w, kind) for kind, words in CLOSED.items() for w in words]
OPEN_ROWS = [(w, kind) for kind, words in OPEN.items() for w in words]
