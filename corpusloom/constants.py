"""Fixed values that results depend on."""

#: White space as Python's \s and str.split see it, for Java and RE2 alike.
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)

#: Candidates, pages and weights of a search.
CHUNK_CANDIDATES, ENTRY_CANDIDATES, EXPANDED_ENTRIES, CHUNKS_PER_ENTRY, PAGE_SIZE = 24, 24, 6, 4, 7
CHUNK_MULTIPLIER, ENTRY_MULTIPLIER = 6, 4
CACHE_SECONDS, CACHED_QUERIES, PREFETCHED_PAGES, MAX_QUERY_CHARS = 600, 32, 1, 300
RERANK_OVERVIEW_WORDS, RERANK_OUTLINE_LINES = 220, 18
CHUNK_COSINE, CHUNK_PARENT, CHUNK_TITLE, CHUNK_SECTION = 0.75, 0.8, 0.35, 0.2
ENTRY_COSINE, ENTRY_TITLE = 1.0, 1.0
LOW_RERANK, LOW_COSINE = -2.0, 0.3

#: Words of chunks and introductions.
MIN_WORDS, MAX_WORDS, WINDOW_WORDS, OVERLAP_WORDS, MAX_OVERLAP_SENTENCE = 300, 400, 350, 40, 80
INTRO_WORDS = 350

#: Graph building and drawing.
SEMANTIC_THRESHOLD, SEMANTIC_NEIGHBORS, MIN_EXPLICIT_DEGREE = 0.85, 5, 3
EVAL_RESULTS, EVAL_CANDIDATES, EVAL_SNIPPET = 3, 20, 220
DIMENSION = 768

#: Fixed value: the namespace of entry ids.
ENTRY_NAMESPACE = "2b1f4a29-0f2a-4707-8588-a507a4f9622f"

#: Words that lexical matching ignores.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "between", "by", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "view", "what", "with"]

#: Labels, their colours, other spellings, and the labels of topics.
DEFAULT_COLOR = "#94a3b8"
COLORS = {
    "Aesthetics": "#d97706",
    "Asian Philosophy": "#7c3aed",
    "Epistemology": "#2563eb",
    "Ethics": "#dc2626",
    "Feminist Philosophy": "#db2777",
    "History of Philosophy": "#8b5e3c",
    "Logic": "#0f766e",
    "Metaphysics": "#16a34a",
    "Philosophy of Language": "#ca8a04",
    "Philosophy of Mathematics": "#4f46e5",
    "Philosophy of Mind": "#0891b2",
    "Philosophy of Religion": "#9333ea",
    "Philosophy of Science": "#0284c7",
    "Political Philosophy": "#b91c1c",
}
ALIASES = {
    "aesthetics": "Aesthetics",
    "asian philosophy": "Asian Philosophy",
    "epistemology": "Epistemology",
    "ethics": "Ethics",
    "feminist philosophy": "Feminist Philosophy",
    "history of philosophy": "History of Philosophy",
    "logic": "Logic",
    "metaphysics": "Metaphysics",
    "philosophy of language": "Philosophy of Language",
    "language, philosophy of": "Philosophy of Language",
    "philosophy of mathematics": "Philosophy of Mathematics",
    "mathematics, philosophy of": "Philosophy of Mathematics",
    "philosophy of mind": "Philosophy of Mind",
    "mind, philosophy of": "Philosophy of Mind",
    "philosophy of religion": "Philosophy of Religion",
    "religion, philosophy of": "Philosophy of Religion",
    "philosophy of science": "Philosophy of Science",
    "science, philosophy of": "Philosophy of Science",
    "political philosophy": "Political Philosophy",
    "social and political philosophy": "Political Philosophy",
}
TOPIC_LABELS = {
    "0": "Philosophy of Mind",
    "1": "History of Philosophy",
    "2": "Political Philosophy",
    "3": "Philosophy of Science",
    "4": "Metaphysics",
    "5": "Epistemology",
    "6": "History of Philosophy",
    "7": "Asian Philosophy",
    "8": "Philosophy of Science",
    "9": "Epistemology",
    "10": "Aesthetics",
    "11": "Logic",
    "12": "Metaphysics",
    "13": "Ethics",
    "14": "Feminist Philosophy",
    "15": "Philosophy of Mathematics",
    "16": "Metaphysics",
    "17": "Philosophy of Language",
    "18": "History of Philosophy",
    "19": "Philosophy of Science",
}
MIN_TOPIC_PROBABILITY = 0.15
LABEL_FIELDS = ["subdiscipline", "discipline", "category", "area"]
