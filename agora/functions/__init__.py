"""Column functions: text, frames, urls, and strict parsing of structured replies."""
