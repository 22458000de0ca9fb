"""kinfold: duplicate-resolution analytics for large media and document catalogues on PySpark."""
