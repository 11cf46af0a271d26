"""xylem: XML documents as columnar node tables, queried with Spark."""
