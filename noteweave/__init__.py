"""Clinical coding analytics on Spark: DataFrame-to-DataFrame operators over notes and code catalogues."""
