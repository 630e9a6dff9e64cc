from tabulens.functions import coerce, formulas, text  # noqa: F401
