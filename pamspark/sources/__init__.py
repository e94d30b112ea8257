"""Reading, writing and declaring tables."""
