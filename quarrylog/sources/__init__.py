"""Reading relations: Parquet tables, folders of fact relations, and the binary fact file."""
