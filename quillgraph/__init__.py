"""quillgraph: text-to-knowledge-graph analytics as declarative Spark plans."""
