"""Operators for preparing training corpora: joins, filters, packing, coding."""
