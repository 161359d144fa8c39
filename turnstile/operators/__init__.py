"""DataFrame operators.  Each takes frames and returns a frame; none runs a job."""
