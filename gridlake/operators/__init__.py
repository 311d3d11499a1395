"""Relational operators over grids, catalogues and wide tables."""
