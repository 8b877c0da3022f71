"""Readers and writers: Parquet tables, delimited report files, XML dumps, labels and literature."""
