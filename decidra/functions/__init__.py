"""Column functions: text, probabilities, options, language, mail, rational solvers."""
