"""Functions of texts and patterns: translations to Spark's dialects, and Arrow functions where built-in ones don't do."""
