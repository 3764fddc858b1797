"""Reading samples, writing and reading models, results and reports."""
