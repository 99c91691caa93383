"""Writers, model folders and the run log."""
