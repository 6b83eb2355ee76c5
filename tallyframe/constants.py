"""Texts, patterns and numbers that results depend on literally."""

# Answer tags. A match is the first of these alternatives; each has one capture group.
ANSWER_PATTERN = (
    r"<answer>(.*?)</answer>"
    r"|\(answer>(.*)<\\/answer>"
    r"|\(answer\)(.*)\(answer\)"
    r"|\(answer\)(.*)<\|eot_id\|>"
    r"|\(Answer\)(.*)<\|eot_id\|>"
    r"|\(answer>(.*)<\|eot_id\|>"
    r"|<Solution><Answer>(.*)</Solution>"
)
ANSWER_GROUPS = 7

# An answer holding one of these (case-sensitive) counts as no answer.
NO_ANSWER_MARKERS = ("Unknown", "None", "No Information provided", "Not specified")

# Yes/no tags: with optional blanks after the hashes, and the strict form without.
YES_NO_PATTERN = r"###\s*(yes|no)"
YES_NO_STRICT_PATTERN = r"###(yes|no)"

# Replacement for an empty label in prompts, and in feature building.
EMPTY_LABEL_TEXT = "Not specified in the given Context"
UNANSWERABLE_TEXT = "unanswerable"

# Reminder appended when an output has to be generated again.
FORMAT_REMINDER = "Please Format your response as specified in the prompt!"
RETRY_LIMIT = 3
REPETITION_SHARE = 0.3

# Separators of the item and annotation formats.
ANSWER_JOINER = " ; "
PART_JOINER = ", "
GAP_MARKER = "[...]"
RULE_LINE = "=" * 50

# Span labels of the annotation documents.
SPAN_TYPE = "custom.Span"
RELATION_TYPE = "webanno.custom.AlternativeLabel"
TEXT_TYPE = "uima.cas.Sofa"
MISSING_SPAN_LABEL = "unlabeled"
ERRONEOUS_LABELS = ("erronous_question", "erroneous_question")
NOT_OTHER_LABELS = (
    "label",
    "alternative_label",
    "alternative_label_part",
    "label_candidate",
    "label_candidate_part",
    "likely answer",
)

# Threshold grids: (number of steps, step). Threshold i is i * step.
VOTE_SWEEP = (21, 0.05)
RANKING_SWEEP = (101, 0.01)

# Characters Python's str.strip() and str.split() treat as blanks.
PYTHON_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
