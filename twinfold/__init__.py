"""Content parity of page pairs at corpus scale: blocks from HTML and Markdown, their alignment, findings and verdicts, as DataFrames."""

__version__ = "0.1.0"
