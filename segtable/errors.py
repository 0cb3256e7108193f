"""The one error of the segment format."""


class SegmentError(ValueError):
    """Bytes that are no segment table, or a damaged one."""
