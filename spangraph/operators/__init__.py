"""DataFrame operators: every public function takes DataFrames and keywords and returns a DataFrame."""
