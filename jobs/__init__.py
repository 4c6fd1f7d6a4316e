"""Jobs over the library: each a function of a session and plain paths, with a command line."""
