"""inkwell: a search engine for personal-blog posts, built from Spark DataFrames."""
