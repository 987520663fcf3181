"""Inputs that the registered queries need and the test tables lack: encoded stream records and their arrival."""
