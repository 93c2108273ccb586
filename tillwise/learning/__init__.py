"""Training, scoring, evaluation and explanation of models with Spark ML."""
