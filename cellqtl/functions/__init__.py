"""Part of the cellqtl library."""
