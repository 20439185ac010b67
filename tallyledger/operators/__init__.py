"""DataFrame-to-DataFrame operators without Python per row.

All are lazy but the robust statistics, which write their frequency table once before they plan on.
"""
