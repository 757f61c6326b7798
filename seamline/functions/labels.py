"""Draft labels of cues: cue class, topic, question value and topic normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes in order of precedence, exclusions, topics in order of precedence, and the topic schema.
CLASSES = [
    ("A_Concept_Introduction", r"\b(let'?s define|we define|x is|this is called|the key idea is|in other words|what is|definition|means that)\b"),
    ("B_Worked_Example", r"\b(let'?s take (an )?example|for example|for instance|suppose (we )?have|consider (the )?case|imagine that|let'?s say)\b"),
    ("C_Explanation_Shift_Major", r"\b(intuitively|formally|mathematically|in practice|practically|from theory to|from intuition to|application|real[- ]world|implementation)\b"),
    ("D_Practical_Important_Point", r"\b(this is important|important point|you should remember|keep in mind|be careful|note that|in practice|tip|best practice|rule of thumb)\b"),
    ("E_High_Value_QA", r"\b(question|you may ask|you might ask|why (do|does)|how (do|does)|common question|good question|q and a|clarify)\b"),
]
EXCLUDED = [r"\b(assignment|deadline|assessment|marks?|attendance|tutorial allocation|email me)\b", r"\b(so|okay|ok|um|uh|right)\b[\.,!\?]?$"]
SHORTEST = 16
TOPICS = [
    (r"\bnumpy\b", "NumPy Array Operation"),
    (r"\bpandas\b|\bdata frame\b|\bdataframe\b", "DataFrame Processing Example"),
    (r"\bartificial intelligence\b|\bai\b", "AI Definition"),
    (r"\bmachine learning\b", "Machine Learning Concept"),
    (r"\bsupervised\b|\bunsupervised\b", "Supervised vs Unsupervised Learning"),
    (r"\bloss\b|\bmse\b|\bcost function\b", "Loss Function Explanation"),
    (r"\bgradient descent\b", "Gradient Descent"),
    (r"\bclassification\b|\bclassifier\b", "Classification"),
    (r"\bregression\b", "Regression"),
    (r"\bneural network\b|\bmlp\b", "Neural Networks"),
    (r"\bcnn\b|\bconvolution\b", "Convolutional Neural Network"),
    (r"\bpooling\b", "Pooling Layers"),
    (r"\brelu\b|\bactivation\b", "Activation Functions"),
    (r"\broc\b|\bauc\b|\bprecision\b|\brecall\b|\bf1\b", "Evaluation Metrics"),
    (r"\bfeature engineering\b|\bfeature\b", "Feature Engineering"),
    (r"\bmodel\b|\btraining\b|\bhyperparameter\b", "Model Training"),
    (r"\bself[- ]driving\b", "Self-driving Car Example"),
    (r"\bstructural engineering\b|\bcivil engineering\b", "Structural Engineering Example"),
    (r"\bsoftware engineering\b", "Software Engineering Example"),
    (r"\bproject\b|\bmvp\b|\bprototype\b", "Project Design"),
    (r"\bcommerciali[sz]ation\b", "Project Commercialisation"),
    (r"\bquestion\b|\bq and a\b|\bclarify\b", "Student Clarification"),
]
#: Every topic of a pattern but the last stands as it is.
KEPT_TOPICS = sorted({name for _, name in TOPICS} - {"Student Clarification"})
QA_TERMS = ["numpy", "pandas", "machine learning", "ai", "model", "feature", "probability", "gradient", "classification", "regression", "how do", "why", "what is"]
CONCEPT_FAMILY = ["AI Definition", "Concept Definition", "Core Concept", "Machine Learning Concept"]


def _first(rules: list[tuple[Column, str]], otherwise: Column) -> Column:
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), otherwise)


def excluded(text: Column) -> Column:
    """Cues that never carry a boundary: very short, administrative, or trailing off in a filler."""
    return (F.length(F.trim(text)) < SHORTEST) | F.rlike(F.trim(text), F.lit("(?i)" + "|".join(EXCLUDED)))


def cue_class(text: Column) -> Column:
    """The first class whose pattern occurs, or null."""
    return F.when(~excluded(text), _first([(F.rlike(text, F.lit(f"(?i){p}")), name) for name, p in CLASSES], F.lit(None).cast("string")))


def topic(text: Column) -> Column:
    t = F.lower(text)
    rules = [(F.rlike(t, F.lit(p)), name) for p, name in TOPICS]
    rules += [(F.contains(t, F.lit("example")), "Worked Example"), (F.rlike(t, F.lit("define|definition|what is")), "Concept Definition")]
    return _first(rules, F.lit("General Explanation"))


def question_value(label: Column, text: Column, topic: Column) -> Column:
    """Splits the question class in two by length, terms and topic; other labels stay."""
    points = (F.length(text) >= 45).cast("int") + F.rlike(F.lower(text), F.lit("|".join(QA_TERMS))).cast("int") + (~topic.isin("Student Clarification", "General Explanation")).cast("int")
    return F.when(label != "E_High_Value_QA", label).otherwise(F.when(points >= 2, "E1_High_Value_QA").otherwise("E2_Minor_QA"))


def schema_topic(label: Column, topic: Column, text: Column) -> Column:
    """A topic of the schema: as it is, or the label's default."""
    t = F.lower(text)
    defaults = [
        (topic.isin(KEPT_TOPICS), topic),
        ((label == "A_Concept_Introduction") & F.rlike(t, F.lit("definition|what is")), "Concept Definition"),
        (label == "A_Concept_Introduction", "Core Concept"),
        (label == "B_Worked_Example", "Worked Example"),
        (label == "C_Explanation_Shift_Major", "Theory-to-Practice Shift"),
        (label == "D_Practical_Important_Point", "Practical Guidance"),
        ((label == "E1_High_Value_QA") & F.rlike(t, F.lit("how do|how to")), "Technical Clarification"),
        (label == "E1_High_Value_QA", "High-value Clarification"),
        (label == "E2_Minor_QA", "Minor Clarification"),
    ]
    return _first(defaults, F.lit("General Topic"))
