import os
import sys

A = 1
