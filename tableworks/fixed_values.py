"""Constants that have to equal the public behaviour being reproduced."""

# The safety taxonomy, code and name.
SAFETY_TAXONOMY = [
    ("S1", "Violence"),
    ("S2", "Sexual"),
    ("S3", "Criminal Planning/Confessions"),
    ("S4", "Guns and Illegal Weapons"),
    ("S5", "Controlled/Regulated Substances"),
    ("S6", "Suicide and Self Harm"),
    ("S7", "Sexual (minor)"),
    ("S8", "Hate/Identity Hate"),
    ("S9", "PII/Privacy"),
    ("S10", "Harassment"),
    ("S11", "Threat"),
    ("S12", "Profanity"),
    ("S13", "Needs Caution"),
    ("S14", "Other"),
    ("S15", "Manipulation"),
    ("S16", "Fraud/Deception"),
    ("S17", "Malware"),
    ("S18", "High Risk Gov Decision Making"),
    ("S19", "Political/Misinformation/Conspiracy"),
    ("S20", "Copyright/Trademark/Plagiarism"),
    ("S21", "Unauthorized Advice"),
    ("S22", "Illegal Activity"),
    ("S23", "Immoral/Unethical"),
]

# The text around the conversation in a safety prompt.
SAFETY_TASK = (
    "Task: Check if there is unsafe content in the user or agent messages in the below conversation "
    "in accordance with our safety policy with the below categories. Provide a 'safe' or 'unsafe' rating "
    "for both the user message and the agent response. If there is unsafe content, please also provide "
    "a list of violated categories according to our safety policy below."
)
SAFETY_FORMAT = (
    "Provide your safety assessment for the above conversation in the below output JSON format:\n"
    '{"User Safety": safe or unsafe rating for the user message, "Response Safety": safe or unsafe rating '
    'for the agent response. Omit if no agent response present. "Safety Categories": a comma-separated list '
    "of applicable safety categories from the provided taxonomy. Omit if all safe.}"
)
SAFETY_ENDING = "Do not include anything other than the output JSON in your response.\nOutput JSON: "

# Replies of the guarded flow.
INPUT_REFUSAL = "I cannot process this request due to safety concerns."
OUTPUT_REFUSAL = "The generated response was filtered due to safety concerns."
NO_SPEECH = "No speech detected in audio"

# Default text when a trace carries no reasoning.
NO_REASONING = "No internal reasoning trace provided."

# The layout block classes.
BLOCK_TYPES = [
    "Title", "Section-header", "Text", "List-item", "Caption", "Table", "Figure", "Picture",
    "Formula", "Page-header", "Page-footer", "Footnote", "Bibliography", "TOC",
]

# Tags and attributes that survive HTML cleaning.
ALLOWED_TAGS = [
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "em", "strong", "code", "pre", "blockquote", "br",
    "ul", "ol", "li", "table", "thead", "tbody", "tr", "th", "td",
]
ALLOWED_ATTRS = {"table": ["border", "class"], "td": ["colspan", "rowspan"], "th": ["colspan", "rowspan"]}

# Metric names accepted as shorthand for logged ones.
METRIC_ALIASES = {"accuracy": "test_accuracy", "acc": "test_accuracy", "f1": "f1_weighted"}

# Metrics where a smaller number is the better one.
LOWER_IS_BETTER = ["rmse", "mae", "mse", "loss"]

# Text splitting.
SPLIT_SEPARATORS = ["\n\n", "\n", " ", ""]
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120

# Frequent short words of the languages of the quality rules (English, German, French, Spanish).
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "als", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "und", "von", "zu",
    "au", "avec", "dans", "des", "du", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "con", "de", "del", "el", "en", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
]
