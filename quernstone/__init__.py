"""quernstone: sensor analytics and corpus preparation as plain PySpark DataFrame operators."""
