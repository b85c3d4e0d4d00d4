"""vistaframe: a PySpark engine for scene annotations, question-answer tables and model predictions."""

__version__ = "0.1.0"
