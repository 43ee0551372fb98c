"""Document knowledge engine on Spark: files to clean Markdown, metadata, quality gate and packages."""
