"""codequarry: source-code analytics over files, symbols, call graphs, logs and text, as Spark plans."""
