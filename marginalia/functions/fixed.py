"""Word lists, scales and rules that decide results. Kept as plain data."""

# Lexicon of the sentiment measure.
POSITIVE_WORDS = [
    "great", "excellent", "amazing", "fantastic", "wonderful", "awesome", "love", "perfect", "brilliant",
    "outstanding", "superb", "magnificent", "good", "better", "best", "strong", "powerful", "effective",
    "success", "successful", "win", "winning", "achieve", "achievement",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "worst", "hate", "fail", "failure", "wrong", "problem", "issue",
    "difficult", "hard", "struggle", "pain", "hurt", "damage", "broken", "weak", "poor", "worse", "lose",
    "losing",
]

# Function words dropped from record keywords.
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "this", "that",
    "these", "those", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "can", "must", "shall", "it", "he", "she",
    "they", "we", "you", "i",
]

# Common English function words; default stop list of the corpus statistics (an argument everywhere).
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these",
    "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

# Entity labels that are not counted.
SKIPPED_ENTITY_LABELS = ["CARDINAL", "ORDINAL", "QUANTITY", "PERCENT", "TIME", "DATE"]

# Words of certainty in belief statements.
STRONG_WORDS = [
    "must", "never", "always", "essential", "crucial", "vital", "critical", "fundamental",
    "absolutely", "definitely", "certainly", "undoubtedly",
]
MODERATE_WORDS = [
    "should", "important", "necessary", "typically", "generally", "usually", "often", "likely",
    "probably", "tend to",
]

# Ordered keyword classes; the first class with a keyword inside the text wins.
FRAMEWORK_TYPES = [
    ("methodology", ["method", "methodology", "process", "system"]),
    ("framework", ["framework", "model", "approach"]),
    ("strategy", ["strategy", "tactic", "technique"]),
    ("principle", ["principle", "rule", "law"]),
]
BELIEF_TYPES = [
    ("business", ["business", "marketing", "sales", "customer", "profit"]),
    ("personal_development", ["success", "mindset", "habit", "growth", "development"]),
    ("relationships", ["relationship", "people", "trust", "team", "leadership"]),
    ("financial", ["money", "wealth", "financial", "invest", "income"]),
    ("philosophical", ["life", "truth", "value", "principle", "philosophy"]),
    ("strategic", ["strategy", "method", "approach", "system", "process"]),
]
STANDARD_CATEGORIES = [
    ("marketing", ["marketing", "advertising", "promotion"]),
    ("sales", ["sales", "selling", "salesmanship"]),
    ("entrepreneurship", ["entrepreneurship", "business", "startup", "enterprise"]),
    ("mindset", ["mindset", "psychology", "mental", "thinking"]),
    ("relationships", ["relationships", "people", "networking", "social"]),
    ("management", ["management", "leadership", "team", "organization"]),
    ("finance", ["finance", "money", "wealth", "financial"]),
    ("strategy", ["strategy", "planning", "tactics", "approach"]),
    ("productivity", ["productivity", "efficiency", "time", "performance"]),
    ("communication", ["communication", "speaking", "presentation", "persuasion"]),
]
TEMPLATE_RULES = [
    ("tutorial_style", ["how to", "tutorial", "guide", "step by step"]),
    ("comparison", ["compare", "difference", "vs", "versus", "better"]),
    ("best_practices", ["best practice", "optimize", "improve", "efficient"]),
    ("problem_solution", ["problem", "issue", "error", "fix", "solve"]),
    ("concept_explanation", ["what is", "define", "explain", "meaning"]),
    ("framework_focused", ["framework", "methodology", "approach", "process"]),
    ("technical_response", ["technical", "implement", "code", "api"]),
    ("factual_response", ["fact", "data", "statistic", "research"]),
]
TASK_RULES = [
    ("urgency", ["urgent", "deadline", "limited", "scarcity"]),
    ("problem_agitation", ["problem", "pain", "struggle", "frustrat"]),
    ("social_proof", ["proof", "testimonial", "credib", "trust"]),
    ("subject_lines", ["subject", "headline", "title"]),
    ("storytelling", ["story", "narrative", "example"]),
    ("call_to_action", ["action", "cta", "button", "link"]),
    ("benefits", ["benefit", "value", "result", "outcome"]),
    ("objection_handling", ["object", "concern", "doubt", "hesitat"]),
]

# Domains and themes of a corpus report.
KEYWORD_DOMAINS = [
    ("business", ["business", "marketing", "sales", "strategy", "growth", "profit"]),
    ("technology", ["technology", "software", "development", "innovation", "digital"]),
    ("personal_development", ["productivity", "habits", "success", "mindset", "leadership"]),
]
ENTITY_DOMAINS = [
    ("marketing", ["marketing"]),
    ("entrepreneurship", ["entrepreneur"]),
    ("investing", ["invest"]),
]
PHRASE_THEMES = [
    ("entrepreneurship", ["make money", "build business", "start company"]),
    ("productivity", ["time management", "be productive", "get things done"]),
    ("marketing_sales", ["market", "customer", "sell"]),
    ("wealth_building", ["invest", "wealth", "financial"]),
]

# Free words mapped to the five-level scales.
FORMALITY = {
    "very_formal": "very_formal", "formal": "formal", "neutral": "neutral", "informal": "informal",
    "very_informal": "very_informal", "mixed": "neutral", "casual": "informal",
    "professional": "formal",
}
DIRECTNESS = {
    "very_indirect": "very_indirect", "indirect": "indirect", "neutral": "neutral",
    "direct": "direct", "very_direct": "very_direct",
}
FREQUENCY = {
    "never": "never", "rare": "rare", "occasional": "occasional", "frequent": "frequent",
    "constant": "constant", "low": "rare", "medium": "occasional", "high": "frequent",
    "none": "never", "sometimes": "occasional", "often": "frequent", "always": "constant",
}
STYLE_DEFAULTS = {
    "formality": "informal", "directness": "direct", "use_of_examples": "occasional",
    "storytelling": "occasional", "humor": "occasional",
}

# Heading patterns of books, tried in order (case-insensitive, line by line).
CHAPTER_PATTERNS = [
    r"^\s*C\s+H\s+A\s+P\s+T\s+E\s+R\s+\*?\*?[\dIVXLCDM]+\*?\*?.*$",
    r"^\s*Chapter\s+(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen"
    r"|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|Twenty).*$",
    r"^\s*Chapter\s+[\dIVXLCDM]+.*$",
    r"^\s*ULTIMATE\s+MARKETING\s+PLAN\s+SUCCESS.*FACTOR\s*#?[\dIVXLCDM]+.*$",
    r"^\s*Bonus\s+Chapter\s*#?[\dIVXLCDM]+.*$",
    r"^\s*Appendix\s+[A-Z\d]+.*$",
    r"^#{1,3}\s+Chapter.*$",
    r"^#{1,2}\s+[A-Z][A-Z\s]{10,}$",
]
INLINE_HEADING = r"CHAPTER\s+\d+:"

# File handling.
TEXT_SUFFIXES = [".txt", ".md", ".markdown", ".text"]
SYSTEM_FILES = ["Thumbs.db", "desktop.ini", "Icon\r", "__MACOSX"]
SLUG_WORDS = {"$": "dollar", "&": "and", "%": "percent", "@": "at", "+": "plus"}
SLUG_UNDERSCORED = "/\\:*?\"<>|()[]{}#=!~`^"

# Keys of a JSON reply that may hold the answer, in order.
ANSWER_KEYS = ["answer", "result", "response", "content", "core_task", "rag_query"]
