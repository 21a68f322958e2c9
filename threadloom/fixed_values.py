"""Fixed values.

Word lists, formats, lookup tables and constants that results depend on. They are
data, kept in one place and in plain form; change them only together with the results.
"""

# --- fixed values: chat noise -------------------------------------------------
GREETINGS = [
    "hi", "hello", "hey", "good morning", "good afternoon", "good evening", "greetings",
    "howdy", "sup", "what's up", "yo", "hii", "helloo", "thanks", "thank you", "thx", "ty",
    "appreciate it", "cheers", "nice to meet you", "happy to be here",
    "happy to have you here", "glad to see you", "glad to see you here", "glad to be here",
    "bye", "goodbye", "see you later", "see you soon", "see you tomorrow",
    "see you next week", "see you next month", "see you next year",
    "see you in the future",
]
FILLERS = [
    "ok", "okay", "sure", "yeah", "yep", "yup", "nope", "nah", "lol", "haha", "hahaha",
    "hehe", "lmao", "rofl", "👍", "👎", "😊", "😄", "😀", "👍🏻", "👌", "got it", "gotcha",
    "nice", "awesome", "great", "uhm", "um", "uh", "erm", "of course",
]

# --- fixed values: section names of extracted papers --------------------------
SECTION_NAMES = [
    "abstract", "introduction", "references", "bibliography", "conclusion", "conclusions",
    "appendix", "acknowledgments", "acknowledgements", "overview", "background",
    "related work", "discussion", "results", "method", "methods", "implementation",
    "summary", "preface", "foreword", "table of contents", "contents", "index",
]

# --- fixed values: author substring -> base address ---------------------------
AUTHOR_SITES = [
    ("stroustrup", "https://stroustrup.com"),
    ("sutter", "https://herbsutter.com"),
    ("boccara", "https://www.fluentcpp.com"),
    ("grimm", "https://www.modernescpp.com"),
    ("niebler", "https://ericniebler.com"),
]
DEFAULT_SITE = "https://example.com"

# --- fixed values: addresses results are cited by ------------------------------
MAIL_ADDRESS = "https://lists.boost.org/archives/list/"
CHAT_ADDRESS = "https://app.slack.com/"
PAPER_ADDRESS = "https://wg21.link/"
VIDEO_ADDRESS = "https://www.youtube.com/watch?v="
PAPER_PREFIX = "wg21/"

# --- fixed values: paper numbers, tried in this order, ignoring case ----------
PAPER_NUMBER_PATTERNS = [
    r"Document number[:\s]+([PN]\d+[A-Z]?\d*)",
    r"([PN]\d{4}[A-Z]?\d*)\s*[\.:]",
    r"paper\s+([PN]\d{4}[A-Z]?\d*)",
    r"proposal\s+([PN]\d{4}[A-Z]?\d*)",
]

# --- fixed values: markers of program code ------------------------------------
CODE_MARKERS = ["()", "::", "->", "template<", "class ", "struct ", "def ", "import ",
                "#include", "```"]
QUERY_CODE_MARKERS = ["()", "::", "->", ".", "template<", "class ", "struct "]
TECHNICAL_TERMS = ["async", "mutex", "thread", "buffer", "socket", "template", "iterator",
                   "container", "algorithm"]
QUERY_CODE_WORDS = ["function", "class", "method", "code"]

# --- fixed values: query intents, in tie-break order --------------------------
INTENT_PATTERNS = [
    ("how_to", [r"\bhow\s+(do|to|can|should)\b", r"\bsteps?\s+to\b", r"\bguide\b",
                r"\btutorial\b"]),
    ("debug", [r"\berror\b", r"\bexception\b", r"\bfail(ing|ed|s)?\b",
               r"\bcrash(ing|ed)?\b", r"\bnot\s+work(ing)?\b", r"\bproblem\b",
               r"\bissue\b", r"\bbug\b", r"\bsegfault\b", r"\bcore\s+dump\b"]),
    ("code_example", [r"\bexample\b", r"\bcode\s+snippet\b", r"\bsample\s+code\b",
                      r"\bdemonstrat(e|ion)\b", r"\bshow\s+me\b"]),
    ("documentation", [r"\bapi\s+reference\b", r"\bdocumentation\b",
                       r"\bspecification\b", r"\bparameters?\b", r"\breturn\s+type\b",
                       r"\bfunction\s+signature\b", r"\bclass\s+definition\b"]),
    ("mail_history", [r"\bdiscussion\b", r"\bthread\b", r"\bemail\b",
                      r"\bmail(ing\s+list)?\b", r"\bconversation\b",
                      r"\bwas\s+(discussed|mentioned)\b"]),
    ("concept", [r"\bwhat\s+is\b", r"\bexplain\b", r"\bdefinition\b", r"\bmeaning\b",
                 r"\bunderstand\b", r"\bconcept\b"]),
    ("comparison", [r"\bcompare\b", r"\bdifference\s+between\b", r"\bvs\.?\b",
                    r"\bversus\b", r"\b(better|worse)\s+than\b", r"\bwhich\s+to\s+use\b"]),
]

# intent, semantic, bm25, graph, top_k, threshold, sources, graph_depth, max_per_source
ROUTES = [
    ("documentation", 0.3, 0.4, 0.3, 10, 0.75, ["official_docs", "api_reference"], 1, None),
    ("how_to", 0.5, 0.2, 0.3, 15, 0.65, ["tutorials", "guides", "examples"], 2, None),
    ("debug", 0.4, 0.3, 0.3, 20, 0.60, ["mail_archive", "stackoverflow", "issues"], 2, None),
    ("code_example", 0.4, 0.4, 0.2, 10, 0.70, ["examples", "code_samples"], None, None),
    ("mail_history", 0.3, 0.2, 0.5, 15, 0.65, ["mail_archive"], 3, None),
    ("concept", 0.6, 0.2, 0.2, 8, 0.70, ["documentation", "tutorials"], 1, None),
    ("comparison", 0.5, 0.3, 0.2, 12, 0.70, [], None, 2),
    ("unknown", 0.5, 0.25, 0.25, 10, 0.70, [], None, None),
]
# intents that switch on a feature of the route
ROUTE_FLAGS = {
    "enable_multi_query": ["how_to"],
    "include_similar_errors": ["debug"],
    "filter_code_blocks": ["code_example"],
    "use_thread_context": ["mail_history"],
    "sender_authority": ["mail_history"],
    "diversity": ["comparison"],
}
DEFAULT_METHOD_WEIGHTS = [("vector", 0.5), ("bm25", 0.2), ("graph", 0.15),
                          ("hierarchical", 0.15)]

# --- fixed values: entities looked for in queries ------------------------------
LIBRARY_NAMES = ["asio", "thread", "beast", "filesystem", "regex", "spirit", "graph",
                 "multi_index", "container", "algorithm"]
KEYWORD_NAMES = ["async", "sync", "thread", "mutex", "lock", "shared_ptr", "unique_ptr",
                 "template", "const", "virtual", "override"]
LANGUAGE_HINTS = [("cpp", ["c++", "cpp"]), ("python", ["python"]), ("boost", ["boost"])]

# --- fixed values: synonyms, in order ------------------------------------------
SYNONYMS = [
    ("async", ["asynchronous", "non-blocking", "concurrent"]),
    ("sync", ["synchronous", "blocking"]),
    ("function", ["method", "routine", "procedure"]),
    ("class", ["object", "type", "struct"]),
    ("error", ["exception", "failure", "issue"]),
    ("performance", ["speed", "efficiency", "optimization"]),
    ("thread", ["worker", "concurrent", "parallel"]),
]
MAX_SYNONYM_QUERIES = 5
MAX_VARIATIONS = 4

# --- fixed values: thresholds ---------------------------------------------------
CHUNK_MIN_CHARS = 10
CHUNK_MIN_WORDS = 3
FORMATTING_RATIO = 0.7
PUNCTUATION_RATIO = 0.5
ANCHOR_WINDOW_SECONDS = 3600
MIN_VIDEO_SECONDS = 60
MAX_VIDEO_SECONDS = 4 * 60 * 60
DENSE_THRESHOLD = 0.3
DENSE_WEIGHT, SPARSE_WEIGHT = 0.6, 0.4
ENSEMBLE_WEIGHT, TFIDF_WEIGHT = 0.9, 0.1
RRF_K = 60
RECENCY_DAYS = 1500.0
BLEND_DAYS = 1800.0
HOP_DECAY = 0.6
EDGE_PRIORS = [("reply", 1.0), ("same_thread", 0.7), ("reference", 0.5), ("similar", 0.3)]
ALERT_LATENCY_MS, ALERT_HIT_RATE, ALERT_ERROR_RATE = 5000.0, 0.3, 0.1

# --- fixed values: video search terms, in order ---------------------------------
VIDEO_CHANNELS = [
    "Meeting C++", "CppCon", "TheCherno", "Jason Turner", "Bisqwit", "Bo Qian",
    "freeCodeCamp.org C++", "Programming with Mosh C++",
]
VIDEO_CREATORS = [
    "Bjarne Stroustrup", "Jason Turner", "Herb Sutter", "Nicolai Josuttis",
    "Chandler Carruth", "Kate Gregory",
]
VIDEO_PLAYLISTS = [
    "C++ tutorial playlist", "C++ complete course", "C++ from scratch",
    "C++ advanced topics", "C++ STL tutorial",
]
SEARCH_TERMS = [
    "C++ programming", "C++ tutorial", "C++ tutorial for beginners", "C++ advanced",
    "C++ course", "C++ programming language",
    "C++11", "C++14", "C++17", "C++20", "C++23", "modern C++", "C++ standard",
    "C++ pointers", "C++ references", "C++ memory management", "C++ smart pointers",
    "C++ RAII", "C++ templates", "C++ template metaprogramming", "C++ lambda",
    "C++ lambda expressions", "C++ STL", "C++ standard library", "C++ containers",
    "C++ iterators", "C++ algorithms",
    "C++ classes", "C++ inheritance", "C++ polymorphism", "C++ virtual functions",
    "C++ operator overloading", "C++ exceptions", "C++ move semantics",
    "C++ rvalue references", "C++ constexpr", "C++ const", "C++ const correctness",
    "C++ concurrency", "C++ multithreading", "C++ threads", "C++ async", "C++ futures",
    "C++ promises", "C++ mutex", "C++ lock", "C++ atomic", "C++ memory model",
    "C++ data structures", "C++ algorithms", "C++ sorting", "C++ binary search",
    "C++ graph algorithms", "C++ tree", "C++ hash table", "C++ map", "C++ vector",
    "C++ list", "C++ deque", "C++ set", "C++ unordered_map",
    "C++ design patterns", "C++ SOLID principles", "C++ best practices",
    "C++ code review", "C++ clean code", "C++ refactoring", "C++ testing",
    "C++ unit testing", "C++ TDD",
    "C++ performance", "C++ optimization", "C++ profiling", "C++ benchmarking",
    "C++ cache optimization", "C++ compiler optimization",
    "Boost C++", "Qt C++", "C++ OpenCV", "C++ SFML", "C++ SDL", "C++ Eigen",
    "C++ spdlog", "C++ fmt", "C++ catch2", "C++ gtest",
    "C++ game development", "C++ game engine", "C++ graphics programming",
    "C++ embedded", "C++ embedded systems", "C++ systems programming",
    "C++ network programming", "C++ socket programming", "C++ database",
    "C++ web development", "C++ backend",
    "C++ CMake", "C++ Makefile", "C++ gcc", "C++ clang", "C++ MSVC", "C++ Visual Studio",
    "C++ CLion", "C++ VS Code", "C++ debugger", "C++ gdb", "C++ valgrind",
    "C++ sanitizers",
    "C++ interview", "C++ interview questions", "C++ coding interview", "C++ LeetCode",
    "C++ competitive programming", "C++ programming challenges", "C++ projects",
    "C++ portfolio",
    "C++ RAII", "C++ copy constructor", "C++ move constructor", "C++ destructor",
    "C++ friend", "C++ namespace", "C++ enum", "C++ union", "C++ struct", "C++ typedef",
    "C++ using", "C++ auto", "C++ decltype", "C++ typeid", "C++ RTTI", "C++ CRTP",
    "C++ SFINAE", "C++ concepts", "C++ modules", "C++ coroutines", "C++ ranges",
    "C++ span", "C++ string_view", "C++ optional", "C++ variant", "C++ any",
    "C++ filesystem", "C++ chrono", "C++ regex", "C++ random", "C++ iostream",
    "C++ fstream", "C++ string", "C++ array", "C++ tuple", "C++ pair",
]

# --- fixed values: English stop words, the list Spark's StopWordsRemover ships ----
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could",
    "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's", "where's",
    "who's", "why's", "would",
]

# Subtitle files.
CUE_ARROW = "-->"
CUE_ROLLING = "align:start position:0%"
CUE_TIMES = r"^(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})"
