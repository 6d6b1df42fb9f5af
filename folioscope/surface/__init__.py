"""What the outside sees: settings, tools, HTTP, the command line and model providers."""
