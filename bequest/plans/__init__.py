"""Report plans: frames in, frame out, for all ids at once."""
