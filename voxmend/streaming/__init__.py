"""Record transforms over streams."""
